"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints that differ in at most ``radius`` bits are found without misses:
each bit position gets a vector of ``radius + 1`` bits, and there is one table
for each non-zero vector ``v``, whose mask keeps the positions at odd inner
product with ``v``. Any ``radius`` positions span less than the whole space,
so some ``v`` is orthogonal to all of them: in that table the differing bits
are masked out and the two fingerprints meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickpath.llm.graph import components
from clickpath.llm.pairs import Split, bucket_blocks, union
from clickpath.llm.store import keyed, release, stored
from clickpath.llm.textops import LOWER, NOT_SPACE, binary_array, split, words

BITS = 64
RADIUS = 3
SHINGLE = 3


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The covering masks: ``2 ** (radius + 1) - 1`` of them, each with about half the bits.

    The vectors are dealt to the bit positions in turn, so all non-zero ones
    occur about equally often.
    """
    space = 1 << (radius + 1)
    vectors = [1 + i % (space - 1) for i in range(bits)]
    return [sum(1 << i for i, x in enumerate(vectors) if bin(x & v).count("1") % 2) for v in range(1, space)]


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the 64-bit hashes; 0 if there are none."""
    if not len(hashes):
        return 0
    if len(hashes) < 256:
        ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        columns = hashes.view(np.uint8).reshape(-1, 8)
        ones = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, id, text_hash, fp long)``: the fingerprint of every whole text, as a signed long."""

    def run(batches):
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = np.zeros(len(batch), np.uint64)
            for i, j, data, offsets in split(batch.column("text")):
                data = LOWER[data]
                starts, ends, bounds = words(data, offsets, NOT_SPACE)
                # one space between words, so that a shingle is one slice
                lens = ends - starts
                at = np.concatenate([[0], np.cumsum(lens + 1)])
                joined = np.full(at[-1], 0x20, np.uint8)
                step = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
                joined[np.repeat(at[:-1], lens) + step] = data[np.repeat(starts, lens) + step]
                raw, first, last = joined.tobytes(), at[:-1].tolist(), (at[1:] - 1).tolist()
                for d in range(j - i):
                    lo, hi = int(bounds[d]), int(bounds[d + 1])
                    if hi - lo > shingle:
                        h = [digest(raw[s:e], 42) for s, e in zip(first[lo:hi - shingle + 1], last[lo + shingle - 1:hi])]
                    elif hi > lo:
                        h = [digest(raw[first[lo]:last[hi - 1]], 42)]
                    else:
                        continue
                    out[i + d] = fingerprint(np.array(h, np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("id"), batch.column("text_hash"), pa.array(out.view(np.int64))], ["doc_id", "id", "text_hash", "fp"])

    return keyed(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, id long, text_hash long, fp long")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs (doc_id, text)``.

    Texts with the same fingerprint form a class; only the distinct
    fingerprints go through the tables. A bucket's links are found in blocks
    and reported as a forest, never as all its pairs.

    Null and empty texts have fingerprint zero and link like any other. Texts
    of fewer than ``shingle`` words have one shingle. Repeated rows give
    repeated results; a null ``doc_id`` names no group, and a group of
    nothing else has a null ``component_id``. An empty
    table gives no rows; other columns are ignored.
    """
    prints, named = _named(docs, shingle, radius)
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    grouped = prints.join(named.drop("least").join(least, "root"), "fp")
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def _named(docs: DataFrame, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Every row's ``(doc_id, id, text_hash, fp)``, and for each fingerprint ``(fp, least, root)``: its smallest id, null if it has none, and the fingerprint that names its group."""
    spark: SparkSession = docs.sparkSession
    prints = stored(spark, fingerprints(docs, shingle), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    keep = [m - (1 << 64) if m >> 63 else m for m in masks(radius)]
    tables = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for k, m in enumerate(keep)]))
    rows = classes.select(F.col("fp").alias("node"), tables.alias("b")).select(F.xxhash64("b.t", "b.k").alias("bucket"), "node")
    rows = stored(spark, rows, "tables")

    def solve(block: Split) -> pa.RecordBatch:
        node = block.column("node")
        roots = union(block, "node", lambda x, y: np.bitwise_count(x[:, None] ^ y[None, :]) <= radius, as_type=np.uint64)
        part = roots != np.arange(len(node))
        return pa.RecordBatch.from_arrays([pa.array(node[part]), pa.array(node[roots[part]])], ["a", "b"])

    links = bucket_blocks(rows, solve, "a long, b long")
    found = components(spark, links)
    release(rows)
    named = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return prints, named


def simhash_keep(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group, the one with the smallest ``doc_id``.

    Of rows that repeat an id in a group, the one with the least text hash
    stays, and of equal rows one. Rows without an id stay only if their group
    has no others.
    """
    prints, named = _named(docs, shingle, radius)
    # copies meet in the aggregate of their fingerprint, map-side; only fingerprints are joined
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    heads = prints.groupBy("fp").agg(F.min(order).alias("head")).join(named, "fp")
    first = (heads.groupBy("root").agg(F.min("head").alias("least"))
             .select(F.struct("least.none", F.coalesce("least.doc_id", F.lit(0)).alias("id"), "least.text_hash").alias("first")).distinct())
    key = "row"
    while key in {c.lower() for c in docs.columns}:
        key += "_"
    number = F.col("doc_id").cast("long")
    row = F.struct(number.isNull().alias("none"), F.coalesce(number, F.lit(0)).alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"))
    # copies of a row are reduced to one before they are shuffled, however many there are
    rows = docs.withColumn(key, row).dropDuplicates([key])
    return rows.join(first, rows[key] == first["first"], "left_semi").drop(key)
