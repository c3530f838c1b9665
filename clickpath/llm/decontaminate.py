"""Benchmark decontamination: a broadcast hash set of the benchmark's normalised n-grams against all training windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpath.llm.store import keyed, ship
from clickpath.llm.textops import LOWER, gram_hashes, merged, span_hashes, split, table, words

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark windows that are broadcast at once; a larger benchmark is scanned for in blocks.
BLOCK_BYTES = 64 << 20

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: digits, a-z and all of UTF-8's bytes from 0x80.
WORD = table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_BITS = 20


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """``(n, h, words, item)``: the windows of every item; an item of fewer words, but not none, is one window."""

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in split(batch.column("text")):
                data = LOWER[data]
                starts, ends, bounds = words(data, offsets, WORD)
                h = span_hashes(data, starts, ends)
                raw = data.tobytes()
                rows = []
                for d in range(j - i):
                    lo, hi = int(bounds[d]), int(bounds[d + 1])
                    n = min(window, hi - lo)
                    if n:
                        for k, g in enumerate(gram_hashes(h[lo:hi], n).view(np.int64).tolist()):
                            rows.append((n, g, b" ".join(raw[starts[x]:ends[x]] for x in range(lo + k, lo + k + n)), batch.column("item")[i + d].as_py()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.string()))], ["n", "h", "words", "item"])

    ship(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return items.mapInArrow(run, "n int, h long, words binary, item string").distinct()


def _pack(rows) -> dict:
    """The windows of a block by length: sorted hashes, a bitmap of their upper bits, and their words and items by hash."""
    out: dict = {}
    for r in rows:
        out.setdefault(r["n"], {}).setdefault(r["h"], {}).setdefault(bytes(r["words"]), set()).add(r["item"])
    packed = {}
    for n, by_hash in out.items():
        h = np.array(sorted(by_hash), np.int64).view(np.uint64)
        seen = np.zeros(1 << _BITS, bool)
        seen[h >> np.uint64(64 - _BITS)] = True
        packed[n] = (h, seen, {k: {w: frozenset(x for x in items if x is not None) for w, items in v.items()} for k, v in by_hash.items()})
    return packed


_SCHEMA = "doc_id long, text string, n_words long, starts array<long>, ends array<long>, items array<string>"


def _blocks(benchmark: DataFrame, window: int, block_bytes: int):
    """Broadcasts of the benchmark's windows, each of about ``block_bytes`` at most."""
    windows = _windows(benchmark, window)
    total = windows.agg(F.sum(F.length("words") + 64)).first()[0] or 0
    blocks = int(total // block_bytes) + 1
    for k in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod("h", F.lit(blocks)) == k)
        yield benchmark.sparkSession.sparkContext.broadcast(_pack(part.toLocalIterator()))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, text, n_words, starts, ends, items)`` for every row of ``docs (doc_id, text)``.

    ``starts`` and ``ends`` are the maximal runs of document words (by word
    number, end exclusive) inside occurrences of a window of ``benchmark
    (item_id, text)``; ``items`` are the ids, as sorted strings, of the items
    with occurring windows. Hash hits are verified word by word.

    The benchmark's windows are dealt into blocks of about ``block_bytes`` by
    their hash, and each block is broadcast and scanned for in turn, in one
    pass over the documents.

    Null texts have no words; item ids may be of any type and are listed as
    text; null item ids hit words but are not listed;
    repeated items count once. An empty table on either side gives no rows or
    no hits. Other columns are ignored.
    """
    frame = keyed(docs).select("doc_id", "text", F.lit(None).cast("long").alias("n_words"), *[F.array().cast(f"array<{t}>").alias(c) for c, t in (("starts", "long"), ("ends", "long"), ("items", "string"))])
    for shared in _blocks(benchmark, window, block_bytes):
        frame = frame.mapInArrow(_scanner(shared), _SCHEMA)
    return frame


def _find(texts: pa.Array, windows: dict):
    """Words of each text, and its hits as lists of word starts, word ends and sets of items."""
    n_words, starts_of, ends_of, items = np.zeros(len(texts), np.int64), [[] for _ in range(len(texts))], [[] for _ in range(len(texts))], [set() for _ in range(len(texts))]
    for i, j, data, offsets in split(texts):
        data = LOWER[data]
        starts, ends, bounds = words(data, offsets, WORD)
        n_words[i:j] = np.diff(bounds)
        h = span_hashes(data, starts, ends)
        raw = None
        for n, (hashes, seen, found) in windows.items():
            g = gram_hashes(h, n)
            at = np.flatnonzero(seen[g >> np.uint64(64 - _BITS)])
            at = at[np.isin(g[at], hashes)]
            doc = np.searchsorted(bounds, at, "right") - 1
            inside = at + n <= bounds[doc + 1]
            at, doc = at[inside], doc[inside]
            if not len(at):
                continue
            raw = data.tobytes() if raw is None else raw
            for x, d, key in zip(at.tolist(), doc.tolist(), g[at].view(np.int64).tolist()):
                hit = found[key].get(b" ".join([raw[s:e] for s, e in zip(starts[x:x + n].tolist(), ends[x:x + n].tolist())]))
                if hit is not None:
                    starts_of[i + d].append(x - int(bounds[d]))
                    ends_of[i + d].append(x - int(bounds[d]) + n)
                    items[i + d] |= hit
    return n_words, starts_of, ends_of, items


def _scanner(shared):
    def run(batches):
        for batch in batches:
            n_words, starts, ends, items = _find(batch.column("text"), shared.value)
            old = [batch.column(c).to_pylist() for c in ("starts", "ends", "items")]
            runs = [merged(np.array(a + c, np.int64), np.array(b + e, np.int64)) for a, b, c, e in zip(old[0], old[1], starts, ends)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text"), pa.array(n_words),
                pa.array([r[0].tolist() for r in runs], pa.list_(pa.int64())), pa.array([r[1].tolist() for r in runs], pa.list_(pa.int64())),
                pa.array([sorted(x | set(y)) for x, y in zip(items, old[2])], pa.list_(pa.string()))], ["doc_id", "text", "n_words", "starts", "ends", "items"])

    return run


def _dropper(shared):
    def run(batches):
        for batch in batches:
            starts = _find(batch.column(batch.schema.get_field_index("text")), shared.value)[1]
            out = batch.filter(pa.array([not s for s in starts], pa.bool_()))
            if out.num_rows:
                yield out

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` for every row of ``docs``; see :func:`benchmark_hits`."""
    hits = benchmark_hits(docs, benchmark, window)
    covered = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return hits.select("doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns; rows are judged where they stand, nothing is joined."""
    keyed(docs)
    frame = docs
    for shared in _blocks(benchmark, window, block_bytes):
        frame = frame.mapInArrow(_dropper(shared), docs.schema)
    return frame
