"""Suffix-array dedup of byte strings, by expanding intervals on a Burrows-Wheeler transform.

The contexts in which anchors recur (see ``repeats``) are indexed block by
block: their suffixes are sorted, and the Burrows-Wheeler transform gives for
each suffix the one that is longer by the byte before it. All intervals of
suffixes with the same first ``n`` bytes are extended backwards together,
breadth first: the intervals for ``n + 1`` bytes follow from those for ``n``,
and a suffix whose interval splits off at that step has a common prefix of
exactly ``n`` bytes with its neighbour. The expansion stops at the minimum
length; suffixes still together share that many bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpath.llm.repeats import Units, covered, runs_of, with_cover
from clickpath.llm.store import keyed
from clickpath.llm.textops import U64, binary_array, flat, gram_hashes, mix

LENGTH = 50
#: Longer grams recur by chance less often, shorter ones make fewer anchors; the result is the same.
GRAM = 24


def suffix_order(text: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of all strings in order and their places, by doubling up to ``depth`` bytes.

    ``ends[i]`` is the end of the string that byte ``i`` is part of. A string's
    end sorts before every byte; suffixes equal in ``depth`` bytes may stand
    in any order.
    """
    n = len(text)
    key = np.zeros(n, U64)
    room = ends - np.arange(n)
    for k in range(7):
        part = np.zeros(n, U64)
        part[:max(0, n - k)] = text[k:].astype(U64) + U64(1)
        part[room <= k] = 0
        key = key * U64(257) + part
    order = np.argsort(key)
    ranked = key[order]
    new = np.ones(n + 1, bool)  # slots that begin a group of suffixes not yet told apart
    new[1:-1] = ranked[1:] != ranked[:-1]
    rank, size = np.empty(n, np.int64), 7
    while size < depth:
        # groups of one are in their place; the others are sorted within their own slots
        open_ = np.flatnonzero(~(new[:-1] & new[1:]))
        if not len(open_):
            break
        rank[order] = np.cumsum(new[:-1])
        at = order[open_]
        nxt = rank[np.minimum(at + size, n - 1)]
        nxt[room[at] <= size] = 0
        key = (rank[at].astype(U64) << U64(32)) | nxt.astype(U64)
        by = np.argsort(key)
        order[open_] = at[by]
        key = key[by]
        new[open_[1:]] |= key[1:] != key[:-1]
        size *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def expand(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(order, place, lcp)``: the common prefix of each suffix with the one before, up to ``length``.

    Breadth-first backward extension. The transform says which byte stands
    before each suffix, and its last-to-first mapping where the suffix that
    starts with that byte stands. Steps go over all intervals of a depth at
    once: suffix ``p`` of the interval of a string ``x`` maps to a suffix in
    the interval of ``cx``, so two neighbours stay together at depth ``n + 1``
    if they begin with the same byte and were together, one byte further on,
    at depth ``n``.
    """
    n = len(text)
    order, place = suffix_order(text, ends, length)
    last = ends[order] - 1 == order
    # the mapping read backwards: where the suffix without its first byte stands
    back = place[np.where(last, order, np.minimum(order + 1, n - 1))].astype(np.int32)
    first = text[order]
    lcp = np.full(n, length, np.int64)
    apart = np.zeros(n, bool)  # at depth 0 all are one interval
    # neighbours (k - 1, k) that are still together, and where they map to
    live = np.arange(1, n, dtype=np.int32)
    before, after = back[:-1], back[1:]
    for depth in range(length):
        if depth == 0:
            split = first[1:] != first[:-1]
        else:
            interval = np.cumsum(apart, dtype=np.int32)
            split = interval[after] != interval[before]
            if depth == 1:
                split |= last[live] | last[live - 1]  # a suffix of one byte goes no further
        gone, stay = live[split], np.flatnonzero(~split)
        lcp[gone] = depth
        apart[gone] = True
        live, before, after = live[stay], before[stay], after[stay]
        if not len(live):
            break
    lcp[:1] = 0
    return order, place, lcp


_BYTES = mix(np.arange(1, 257).astype(U64))


def _grams(data: np.ndarray, offsets: np.ndarray):
    return gram_hashes(_BYTES[data], GRAM), offsets


UNITS = Units(LENGTH, GRAM, _grams, lambda data, offsets, first, last: binary_array(data, first, last))


def solver(length: int):
    """For :func:`repeats.answers`: the smallest id in which each window of the contexts occurs.

    Where an anchor has one distinct context, no other text holds its windows
    apart from copies of that context, so they occur first where it does; only
    the contexts of other anchors are sorted.
    """

    def solve(ctx, anchor, ids, hashes, starts):
        # whole anchors stand together
        new = np.ones(len(anchor) + 1, bool)
        new[1:-1] = anchor[1:] != anchor[:-1]
        alone = new[:-1] & new[1:]
        single, several = np.flatnonzero(alone), np.flatnonzero(~alone)
        size = np.diff(flat(ctx)[1])[single]
        none = np.zeros(len(single), np.int64)
        whole = single, none, size - (length - 1), ids[single], none, none
        if not len(several):
            return whole
        row, *rest = indexed(ctx.take(pa.array(several)), ids[several])
        return tuple(np.concatenate(x) for x in zip(whole, (several[row], *rest)))

    def indexed(ctx, ids):
        text, offsets = flat(ctx)
        sizes = np.diff(offsets)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order, place, lcp = expand(text, offsets[1:][owner], length)
        group = np.cumsum(lcp < length) - 1
        least = np.minimum.reduceat(ids[owner[order]], np.flatnonzero(lcp < length))
        first = least[group][place]  # for each byte, the smallest id with the string that starts there
        window = np.arange(len(text)) + length <= offsets[1:][owner]
        at = np.flatnonzero(window)
        value, own = first[at], owner[at]
        new = np.ones(len(at), bool)
        new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
        head = np.flatnonzero(new)
        row = own[head]
        w0 = at[head] - offsets[:-1][row]
        w1 = at[np.append(head[1:], len(at)) - 1] - offsets[:-1][row] + 1
        none = np.zeros(len(row), np.int64)
        return row, w0, w1, value[head], none, none

    return solve


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, starts, ends)`` for every row of ``docs (doc_id, text)``: the runs of bytes (of the text as
    UTF-8) inside a string of ``LENGTH`` bytes that also starts in a row with a smaller ``doc_id``.

    Null texts are empty. A null ``doc_id`` counts as larger than all others;
    rows with the same id never cover each other. An empty table gives no
    rows; other columns are ignored. Runs are null where there are none, and
    may overlap; see :func:`repeats.runs_of`.
    """
    base = keyed(docs)
    later = F.col("first_id") < F.col("id")
    return with_cover(base, covered(base, UNITS, solver(LENGTH), later))


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """``(doc_id, kept binary, n_bytes, n_removed, n_spans)``: what is left of each text; see :func:`repeated_bytes`."""
    return repeated_bytes(docs).mapInArrow(_cutter(False), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def byte_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``: :func:`dedup_bytes` with a digest for the bytes."""
    return repeated_bytes(docs).mapInArrow(_cutter(True), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _cutter(digest: bool):
    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            raw = memoryview(data.tobytes())
            kept, removed, spans = [], np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for r in range(len(batch)):
                lo, hi = int(offsets[r]), int(offsets[r + 1])
                s, e = runs_of(batch, r)
                removed[r], spans[r] = (e - s).sum(), len(s)
                cuts = [lo, *(lo + np.stack([s, e], 1).ravel()).tolist(), hi]
                parts = [raw[a:b] for a, b in zip(cuts[::2], cuts[1::2])]
                if digest:
                    h = hashlib.sha256()
                    for x in parts:
                        h.update(x)
                    kept.append(h.hexdigest())
                else:
                    kept.append(b"".join(parts))
            n = pa.array(np.diff(offsets))
            if digest:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, pa.array(removed), pa.array(spans), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), n, pa.array(removed), pa.array(spans)], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return run
