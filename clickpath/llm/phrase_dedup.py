"""Substring dedup with automata of repeated phrases.

The contexts in which word anchors recur (see ``repeats``) form shards. In
each, windows whose hashes meet twice are taken as candidate phrases, an
Aho-Corasick automaton is compiled from them, and all contexts of the shard
stream through it: every occurrence that it reports is one of the very word
sequence, whatever the hashes said.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpath.llm.repeats import Units, covered, runs_of, with_cover
from clickpath.llm.store import keyed
from clickpath.llm.textops import NOT_SPACE, U64, binary_array, flat, gram_hashes, span_hashes, split, words

LENGTH = 20
GRAM = 6


def _grams(data: np.ndarray, offsets: np.ndarray):
    starts, ends, bounds = words(data, offsets, NOT_SPACE)
    return gram_hashes(span_hashes(data, starts, ends), GRAM), bounds


def _pack(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The words ``first`` to ``last`` joined by one blank."""
    starts, ends, _ = words(data, offsets, NOT_SPACE)
    lens = ends - starts
    at = np.concatenate([[0], np.cumsum(lens + 1)])
    joined = np.full(at[-1], 0x20, np.uint8)
    step = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    joined[np.repeat(at[:-1], lens) + step] = data[np.repeat(starts, lens) + step]
    return binary_array(joined, at[first], at[last] - 1)


UNITS = Units(LENGTH, GRAM, _grams, _pack, within=True)


def solver(length: int):
    """For :func:`repeats.answers`: where each window of the contexts occurs first."""

    def solve(ctx, anchor, ids, hashes, starts):
        data, offsets = flat(ctx)
        w_start, w_end, bounds = words(data, offsets, NOT_SPACE)
        raw = data.tobytes()
        # words as numbers, by their bytes
        numbers: dict[bytes, int] = {}
        seq = [numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(w_start.tolist(), w_end.tolist())]
        grams = gram_hashes(span_hashes(data, w_start, w_end), length)
        at = np.arange(len(grams))
        owner = np.searchsorted(bounds, at, "right") - 1
        inside = at + length <= bounds[owner + 1]
        at, owner, grams = at[inside], owner[inside], grams[inside]
        _, one, inverse, many = np.unique(grams, return_index=True, return_inverse=True, return_counts=True)
        # every candidate is compiled; a window met once occurs first where it stands
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        place = (ids[owner], hashes[owner], starts[owner] + at - bounds[owner])
        phrase = np.full(len(seq), -1, np.int64)
        phrase[at] = len(one) + np.arange(len(at))
        made = 0
        for k in np.flatnonzero(many[inverse] > 1).tolist():
            w = int(at[k])
            key = tuple(seq[w:w + length])
            if not automaton.exists(key):
                automaton.add_word(key, made)
                made += 1
        if made:
            automaton.make_automaton()
            busy = np.unique(owner[many[inverse] > 1])
            for lo, hi in zip(bounds[busy].tolist(), bounds[busy + 1].tolist()):
                for end, number in automaton.iter(tuple(seq[lo:hi])):
                    phrase[lo + end - length + 1] = number
        found = phrase[at]
        order = np.lexsort((place[2], place[1], place[0], found))
        head = np.ones(len(order), bool)
        head[1:] = found[order][1:] != found[order][:-1]
        first = np.empty(len(order), np.int64)
        first[order] = order[np.flatnonzero(head)][np.cumsum(head) - 1]
        # neighbouring windows with neighbouring first occurrences are one row
        f_id, f_hash, f_at = (x[first] for x in place)
        shift = f_at - at
        new = np.ones(len(at), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (f_id[1:] != f_id[:-1]) | (f_hash[1:] != f_hash[:-1]) | (shift[1:] != shift[:-1])
        h = np.flatnonzero(new)
        row = owner[h]
        w0 = at[h] - bounds[row]
        w1 = at[np.append(h[1:], len(at)) - 1] - bounds[row] + 1
        return row, w0, w1, f_id[h], f_hash[h], f_at[h]

    return solve


def repeated_words(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, starts, ends)`` for every row of ``docs (doc_id, text)``: the runs of words inside a window of
    ``LENGTH`` words whose sequence also starts earlier, in a row with a smaller ``doc_id`` or before it in the same row.

    Null texts have no words. A null ``doc_id`` counts as larger than all
    others. Rows with the same id and different texts are ordered by a hash
    of the text; rows equal in both get the same result. An empty table gives
    no rows; other columns are ignored.
    """
    base = keyed(docs)
    later = ((F.col("first_id") < F.col("id")) | ((F.col("first_id") == F.col("id")) & (F.col("first_hash") < F.col("text_hash")))
             | ((F.col("first_id") == F.col("id")) & (F.col("first_hash") == F.col("text_hash")) & (F.col("first_start") < F.col("start") + F.col("w0"))))
    return with_cover(base, covered(base, UNITS, solver(LENGTH), later))


def dedup_words(docs: DataFrame) -> DataFrame:
    """``(doc_id, kept string, n_words, n_removed)``: the words left of each text, joined by one blank; see :func:`repeated_words`."""
    return repeated_words(docs).mapInArrow(_cutter(False), "doc_id long, kept string, n_words long, n_removed long")


def word_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)``: :func:`dedup_words` with a digest for the words."""
    return repeated_words(docs).mapInArrow(_cutter(True), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _cutter(digest: bool):
    def run(batches):
        for batch in batches:
            kept, n, removed = [], np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for i, j, data, offsets in split(batch.column("text")):
                starts, ends, bounds = words(data, offsets, NOT_SPACE)
                raw = data.tobytes()
                n[i:j] = np.diff(bounds)
                for d in range(j - i):
                    lo, hi = int(bounds[d]), int(bounds[d + 1])
                    keep = np.ones(hi - lo, bool)
                    for s, e in zip(*runs_of(batch, i + d)):
                        keep[s:e] = False
                    left = lo + np.flatnonzero(keep)
                    removed[i + d] = hi - lo - len(left)
                    text = b" ".join([raw[a:b] for a, b in zip(starts[left].tolist(), ends[left].tolist())])
                    kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            if digest:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(removed), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(n), pa.array(removed)], ["doc_id", "kept", "n_words", "n_removed"])

    return run
