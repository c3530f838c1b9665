"""Finding what repeats across documents, without shipping every window.

A window is ``length`` consecutive units (bytes or words) of one text. Each
window is represented by the least hash of the short grams inside it, its
anchor, so equal windows have equal anchors, and neighbouring windows mostly
share one. A run is a maximal stretch of windows with the same anchor.

1. Every text's anchors are dealt out by value, as packed arrays that hold
   each anchor once per batch, and those that occur twice are found.
2. The runs of such anchors, and only those, become contexts: the units that
   their windows cover. Equal contexts are merged before they are shuffled.
3. A solver gets the distinct contexts of whole anchors and tells, for each
   window, where it occurs first. Equal windows always meet there.
4. The answers are joined back to all occurrences of their contexts.

Anchors only select; the solver compares the units themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickpath.llm.store import release, stored
from clickpath.llm.textops import U64, flat, merged, mix, sliding_min, split

#: Runs longer than this are cut; they occur where one gram repeats all along.
LONGEST_RUN = 64
#: Bytes of text whose anchors are packed together.
PACKED = 8 << 20
#: Bytes of contexts that a solver gets at once, but for an anchor with more of them.
BLOCK = 1 << 18


@dataclass(frozen=True)
class Units:
    """What windows are made of. ``grams(bytes, offsets)`` gives the hashes of all grams and the units' bounds per text;
    ``pack(bytes, offsets, first, last)`` the contexts of units ``first`` to ``last``. ``within``: repeats inside one
    text count too, so an anchor that stands at two places makes two runs."""

    length: int
    gram: int
    grams: Callable
    pack: Callable
    within: bool = False


def anchor_runs(h: np.ndarray, bounds: np.ndarray, units: Units):
    """Text, first window, number of windows and anchor of every run; windows count from their text's start."""
    width = units.length - units.gram + 1
    if units.within:
        # the place of the least gram, the first one of equals, in the lower bits
        bits = U64(32)
        least = sliding_min((h >> bits << bits) | np.arange(len(h)).astype(U64), width)
    else:
        least = sliding_min(h, width)
    mark = np.zeros(len(least) + 1, np.int32)
    full = np.flatnonzero(np.diff(bounds) >= units.length)
    np.add.at(mark, bounds[full], 1)
    np.add.at(mark, bounds[full + 1] - units.length + 1, -1)
    window = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
    if not len(window):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, U64)
    a = least[window]
    new = np.ones(len(window), bool)
    new[1:] = (a[1:] != a[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(window)))
    if (size > LONGEST_RUN).any():
        parts = -(-size // LONGEST_RUN)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, size = np.repeat(first, parts) + step * LONGEST_RUN, np.minimum(LONGEST_RUN, np.repeat(size, parts) - step * LONGEST_RUN)
    start = window[first]
    text = np.searchsorted(bounds, start, "right") - 1
    a = a[first]
    return text, start - bounds[text], size, h[(a & ((U64(1) << bits) - U64(1))).astype(np.int64)] if units.within else a


def _packs(docs: DataFrame, units: Units, shards: int) -> DataFrame:
    """``(shard, known, told, payload)`` of ``docs (key, text)``: anchors with their texts' keys. Anchors that a batch holds twice are known to
    recur: their occurrences go to any shard; the last ``told`` anchors of a payload, which have no keys there, tell the
    anchors' own shard."""

    def flush(anchors, ids):
        a, d = np.concatenate(anchors), np.concatenate(ids)
        order = np.argsort(a, kind="stable")
        a, d = a[order], d[order]
        if not units.within:
            # an anchor counts once for each text; a text's runs stand next to each other, in its order
            once = np.ones(len(a), bool)
            once[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
            a, d = a[once], d[once]
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        many = np.diff(np.append(np.flatnonzero(new), len(a)))
        twice = np.repeat(many > 1, many)
        once_a, once_d, told_a = a[~twice], d[~twice], a[new & twice]
        shard, told_shard = (once_a % U64(shards)).astype(np.int64), (told_a % U64(shards)).astype(np.int64)
        order, told_order = np.argsort(shard, kind="stable"), np.argsort(told_shard, kind="stable")
        once_a, once_d, told_a = once_a[order], once_d[order], told_a[told_order]
        cuts = np.searchsorted(shard[order], np.arange(shards + 1)).tolist()
        told_cuts = np.searchsorted(told_shard[told_order], np.arange(shards + 1)).tolist()
        rows = []
        for s in range(shards):
            x, y, v, w = cuts[s], cuts[s + 1], told_cuts[s], told_cuts[s + 1]
            if y > x or w > v:
                rows.append((s, False, w - v, once_a[x:y].tobytes() + once_d[x:y].tobytes() + told_a[v:w].tobytes()))
        if twice.any():
            a, d = a[twice], d[twice]
            for at in range(0, len(a), 1 << 16):
                rows.append((int(mix(a[at:at + 1] + d[at:at + 1].astype(U64))[0] % U64(shards)), True, 0, a[at:at + (1 << 16)].tobytes() + d[at:at + (1 << 16)].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.int32(), pa.binary()))], ["shard", "known", "told", "payload"])

    def run(batches):
        anchors, ids, held = [], [], 0
        for batch in batches:
            own = batch.column("key").to_numpy()
            for i, _, data, offsets in split(batch.column("text"), 1 << 18):
                h, bounds = units.grams(data, offsets)
                text, _, _, a = anchor_runs(h, bounds, units)
                anchors.append(a)
                ids.append(own[i + text])
                held += len(data)
                if held >= PACKED:
                    if sum(map(len, anchors)):
                        yield flush(anchors, ids)
                    anchors, ids, held = [], [], 0
        if sum(map(len, anchors)):
            yield flush(anchors, ids)

    return docs.mapInArrow(run, "shard int, known boolean, told int, payload binary")


def _recurring(packs: DataFrame, shards: int) -> DataFrame:
    """``(key, anchor)`` of anchors that occur twice or more."""

    def out(a, d):
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(a.view(np.int64))], ["key", "anchor"])

    def run(batches):
        held, known_a = [], [np.zeros(0, U64)]
        for batch in batches:
            for known, told, payload in zip(*(batch.column(c).to_pylist() for c in ("known", "told", "payload"))):
                n = (len(payload) - 8 * told) // 16
                a, d = np.frombuffer(payload, U64, n), np.frombuffer(payload, np.int64, n, 8 * n)
                if known:
                    yield out(a, d)
                else:
                    held.append((a, d))
                    known_a.append(np.frombuffer(payload, U64, told, 16 * n))
        if held:
            a, d = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            order = np.argsort(a, kind="stable")
            a, d = a[order], d[order]
            new = np.ones(len(a), bool)
            new[1:] = a[1:] != a[:-1]
            many = np.diff(np.append(np.flatnonzero(new), len(a)))
            real = np.repeat((many > 1) | np.isin(a[new], np.concatenate(known_a)), many)
            if real.any():
                yield out(a[real], d[real])

    return packs.repartition(shards, "shard").mapInArrow(run, "key long, anchor long")


def contexts(spark: SparkSession, docs: DataFrame, units: Units) -> DataFrame:
    """``(anchor, ctx, id, text_hash, start)`` of all runs whose anchor occurs twice in ``docs (id, text)``, stored.

    Of equal contexts of one text there is a row each; ``text_hash`` keeps
    apart texts that share an id.
    """
    shards = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows equal in id and text share a key, so a key has no more anchors than one text
    docs = docs.select("id", "text", F.xxhash64("text").alias("text_hash")).withColumn("key", F.xxhash64("id", "text_hash"))
    lists = stored(spark, _recurring(_packs(docs.select("key", "text"), units, shards), shards), "recurring")
    some = lists.groupBy("key").agg(F.collect_set("anchor").alias("anchors"))
    joined = docs.join(some, "key")

    def run(batches):
        for batch in batches:
            own, hashes = batch.column("id"), batch.column("text_hash")
            wanted = batch.column("anchors")
            lists, offs = wanted.values.to_numpy(), wanted.offsets.to_numpy()
            for i, j, data, offsets in split(batch.column("text"), 1 << 18):
                h, bounds = units.grams(data, offsets)
                text, start, size, a = anchor_runs(h, bounds, units)
                real = np.flatnonzero(np.isin(a, lists[offs[i]:offs[j]].view(U64)))
                if not len(real):
                    continue
                text, start, size, a = text[real], start[real], size[real], a[real]
                first = bounds[text] + start
                ctx = units.pack(data, offsets, first, first + size + units.length - 1)
                rows = pa.array(i + text)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), ctx, own.take(rows), hashes.take(rows), pa.array(start)], ["anchor", "ctx", "id", "text_hash", "start"])

    made = joined.mapInArrow(run, "anchor long, ctx binary, id long, text_hash long, start long")
    out = stored(spark, made, "contexts")
    release(lists)
    return out


def answers(found: DataFrame, solve: Callable, within: bool, block: int = BLOCK) -> DataFrame:
    """``(anchor, h, w0, w1, first_id, first_hash, first_start)``: for windows ``w0 .. w1 - 1`` of a context where they occur first.

    ``solve`` gets distinct contexts of whole anchors with the place where
    each occurs first, and gives rows of ``(row, w0, w1, id, text hash,
    start)``. Copies are merged by Spark's partial aggregation before they are
    shuffled, so a context of a third of all texts reaches a solver once.
    """
    place = F.min(F.struct("id", "text_hash", "start")).alias("at") if within else F.struct(F.min("id").alias("id"), F.lit(0).cast("long").alias("text_hash"), F.lit(0).cast("long").alias("start")).alias("at")
    one = found.groupBy("anchor", "ctx").agg(place).select("anchor", "ctx", "at.*")
    one_stored = stored(found.sparkSession, one, "distinct")
    one = one_stored.withColumn("h", F.xxhash64("ctx", "anchor"))

    def emit(rows: pa.Table) -> pa.RecordBatch:
        ctx = rows.column("ctx").combine_chunks() if isinstance(rows.column("ctx"), pa.ChunkedArray) else rows.column("ctx")
        get = lambda c: rows.column(c).to_numpy()
        row, w0, w1, id_, th, st = solve(ctx, get("anchor"), get("id"), get("text_hash"), get("start"))
        return pa.RecordBatch.from_arrays([pa.array(get("anchor")[row]), pa.array(get("h")[row]), pa.array(w0), pa.array(w1), pa.array(id_), pa.array(th), pa.array(st)],
                                          ["anchor", "h", "w0", "w1", "first_id", "first_hash", "first_start"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            a = batch.column("anchor").to_numpy()
            lens = np.diff(flat(batch.column("ctx"))[1])
            at = 0
            while at < batch.num_rows:
                if size >= block:
                    # whole anchors: go on until the anchor changes
                    last = held[-1].column("anchor")[-1].as_py()
                    other = np.flatnonzero(a[at:] != last)
                    stop = at + int(other[0]) if len(other) else batch.num_rows
                    if stop > at:
                        held.append(batch.slice(at, stop - at))
                    if stop < batch.num_rows:
                        yield emit(pa.Table.from_batches(held).combine_chunks())
                        held, size = [], 0
                    at = stop
                else:
                    stop = at + max(1, int(np.searchsorted(np.cumsum(lens[at:]), block - size, "right")))
                    held.append(batch.slice(at, min(stop, batch.num_rows) - at))
                    size += int(lens[at:stop].sum())
                    at = min(stop, batch.num_rows)
        if held:
            yield emit(pa.Table.from_batches(held).combine_chunks())

    made = one.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "anchor long, h long, w0 long, w1 long, first_id long, first_hash long, first_start long")
    out = stored(found.sparkSession, made, "answers")
    release(one_stored)
    return out


def covered(docs: DataFrame, units: Units, solve: Callable, later) -> DataFrame:
    """``(id, text_hash, starts, ends)``: the runs of units inside windows that ``later`` holds for, a condition on occurrences and answers."""
    spark, length = docs.sparkSession, units.length
    found = contexts(spark, docs, units)
    answer = answers(found, solve, units.within)
    hits = (found.select("anchor", F.xxhash64("ctx", "anchor").alias("h"), "id", "text_hash", "start").join(answer, ["anchor", "h"]).where(later)
            .select("id", "text_hash", (F.col("start") + F.col("w0")).alias("s"), (F.col("start") + F.col("w1") + (length - 1)).alias("e")))
    out = stored(spark, hits.groupBy("id", "text_hash").agg(F.collect_list("s").alias("starts"), F.collect_list("e").alias("ends")), "covered")
    release(found, answer)
    return out


def with_cover(docs: DataFrame, cover: DataFrame) -> DataFrame:
    """``docs (doc_id, id, text)`` with ``starts`` and ``ends``, null where nothing is covered."""
    return (docs.withColumn("text_hash", F.xxhash64("text")).join(cover, ["id", "text_hash"], "left").select("doc_id", "text", "starts", "ends"))


def runs_of(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged covered runs of a row of :func:`with_cover`."""
    s, e = batch.column("starts")[row].as_py(), batch.column("ends")[row].as_py()
    return merged(np.array(s or [], np.int64), np.array(e or [], np.int64))
