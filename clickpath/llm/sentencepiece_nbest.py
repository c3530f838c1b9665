"""SentencePiece encoding and decoding with N-best segmentations.

A text becomes ``▁`` + the text with ``▁`` for each blank, and is segmented
over the lattice of the vocabulary's pieces so that the pieces' scores add up
to the most. Forward Viterbi gives each position the best score from the
start. Those scores are exact heuristics for an A-star search from the end
backwards, which therefore meets complete segmentations in the order of their
scores: the N-best.

Where no piece of the vocabulary holds two neighbouring characters, every
segmentation is cut between them, so the lattice falls into short chunks that
are searched once for all their occurrences in a batch. The N best of a text
differ from its best one in at most the N - 1 chunks that lose least by their
second-best segmentation.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpath.llm.store import keyed
from clickpath.llm.textops import U64, mix, seg_sum

BLANK = "▁"
NEG = -1e30
#: Longer chunks are searched one by one instead of in columns.
LONG = 32
#: Characters of texts whose chunks are searched together.
TOGETHER = 1 << 20
#: Chunks whose segmentations a worker remembers.
KEPT = 1 << 18
_P = U64(0x9E3779B97F4A7C15)


class Pieces:
    """The pieces of a model file: normal ones with scores, and one for each byte."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.by_text, self.bytes_of, self.byte_ids = {}, [b""] * sp.get_piece_size(), {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.by_text[piece] = (i, float(sp.get_score(i)))
                self.bytes_of[i] = piece.replace(BLANK, " ").encode()
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte pieces, so it cannot encode every text")
        scores = [s for _, s in self.by_text.values()]
        #: Score of a character that no piece covers; it is written as its bytes.
        self.unknown = min(scores) - 10
        self.longest = max(map(len, self.by_text))
        chars = sorted({c for p in self.by_text for c in p})
        inner = sorted({c for p in self.by_text if len(p) > 1 for c in p})
        self.place = np.zeros(0x110000, np.int32)
        self.place[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.pairs = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        for p in self.by_text:
            for a, b in zip(p, p[1:]):
                self.pairs[self.place[ord(a)], self.place[ord(b)]] = True
        del chars
        h = np.array([self._hash(p) for p in self.by_text], U64)
        order = np.argsort(h)
        self.hashes = h[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have the same hash")
        self.ids = np.array([i for i, _ in self.by_text.values()], np.int64)[order]
        self.scores = np.array([s for _, s in self.by_text.values()])[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hashes >> U64(44)] = True
        lens = np.array([len(b) for b in self.bytes_of], np.int64)
        self.known = _nothing()
        self.raw, self.raw_at, self.raw_len = np.frombuffer(b"".join(self.bytes_of), np.uint8), np.cumsum(lens) - lens, lens

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_P) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return int(mix(np.array([h], U64))[0])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and scores of hashed strings."""
        ids, scores = np.full(len(h), -1, np.int64), np.full(len(h), NEG)
        h = mix(h)
        maybe = np.flatnonzero(self.seen[h >> U64(44)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        real = self.hashes[at] == h[maybe]
        ids[maybe[real]], scores[maybe[real]] = self.ids[at[real]], self.scores[at[real]]
        return ids, scores

    def edges(self, chunk: str, cover: bool = True) -> list[list[tuple[int, int, float]]]:
        """For each end position the lattice's ``(start, id, score)``; id -1 is a character written as bytes."""
        out: list = [[] for _ in range(len(chunk) + 1)]
        for j in range(1, len(chunk) + 1):
            for i in range(max(0, j - self.longest), j):
                hit = self.by_text.get(chunk[i:j])
                if hit:
                    out[j].append((i, *hit))
            if not out[j] or out[j][-1][0] != j - 1:
                out[j].append((j - 1, -1, self.unknown))
        return out

    def forward(self, edges: list) -> list[float]:
        best = [0.0]
        for j in range(1, len(edges)):
            best.append(max(best[i] + s for i, _, s in edges[j]))
        return best

    def n_best(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations as ``(score, ids)``, best first."""
        edges = self.edges(chunk)
        best = self.forward(edges)
        # of equal scores the one nearest to the start goes first, so ties do not make the agenda grow with all of them
        agenda, made, out = [(-best[-1], len(chunk), 0, 0.0, None)], 0, []
        while agenda and len(out) < n:
            cost, pos, _, g, path = heapq.heappop(agenda)
            if pos == 0:
                ids = []
                while path:
                    ids += self.spelled(path[0], path[1])
                    path = path[2]
                out.append((-cost, tuple(ids)))
                continue
            for i, k, s in edges[pos]:
                made += 1
                heapq.heappush(agenda, (-(best[i] + s + g), i, made, s + g, (k, chunk[i:pos], path)))
        return out

    def spelled(self, k: int, text: str) -> list[int]:
        return [k] if k >= 0 else [self.byte_ids[b] for b in (text if text != _LITERAL else BLANK).encode("utf-8", "surrogatepass")]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of a whole text's ids, without the blank put in front."""
        lens = self.raw_len[ids]
        ends = np.cumsum(lens)
        if not len(ids):
            return b""
        out = self.raw[np.arange(ends[-1]) + np.repeat(self.raw_at[ids] - (ends - lens), lens)].tobytes()
        return out[1:] if out[:1] == b" " else out


#: Stands for a ``▁`` that the text itself holds, which is written as bytes, so that blanks and it stay apart.
_LITERAL = "\udc81"  # a lone surrogate, which no UTF-8 text holds


def _columns(p: Pieces, codes: np.ndarray):
    """Best score, second-best score and best ids (with their number) of chunks ``[chunk, character]`` of one length."""
    u, n = codes.shape
    best, second = np.full((n + 1, u), NEG), np.full((n + 1, u), NEG)
    back, piece = np.zeros((n + 1, u), np.int64), np.zeros((n + 1, u), np.int64)
    best[0] = 0
    c = codes.astype(U64).T + U64(1)
    for i in range(n):
        h = np.zeros(u, U64)
        for j in range(i + 1, min(n, i + p.longest) + 1):
            h = h * _P + c[j - 1]
            ids, score = p.find(h)
            if j == i + 1:
                score = np.where(ids < 0, p.unknown, score)
            else:
                if not (ids >= 0).any():
                    continue
            cand, other = best[i] + score, second[i] + score
            better = cand > best[j]
            second[j] = np.maximum(np.maximum(np.where(better, best[j], cand), second[j]), other)
            best[j] = np.where(better, cand, best[j])
            back[j], piece[j] = np.where(better, i, back[j]), np.where(better, ids, piece[j])
    ends = np.zeros((u, n + 1), bool)
    pos, rows = np.full(u, n), np.arange(u)
    while len(rows):
        ends[rows, pos] = True
        pos = back[pos, rows]
        rows, pos = rows[pos > 0], pos[pos > 0]
    row, end = np.nonzero(ends)
    ids = piece[end, row]
    return best[n], second[n], ids, ends.sum(1), codes[row, end - 1]


def _searched(p: Pieces, keys: np.ndarray, start: np.ndarray, size: np.ndarray, joined: np.ndarray):
    """Best and second-best scores, and where the best ids stand in the last array, of distinct chunks by their sorted hashes.

    A worker keeps what it has found from batch to batch, up to ``KEPT``
    chunks; then it starts anew.
    """
    known = p.known
    if len(known[0]) > KEPT:
        known = p.known = _nothing()
    old = known[0]
    at = np.minimum(np.searchsorted(old, keys), max(0, len(old) - 1))
    new = np.flatnonzero(old[at] != keys) if len(old) else np.arange(len(keys))
    best, second, lens = np.zeros(len(new)), np.full(len(new), NEG), np.zeros(len(new), np.int64)
    place, parts, base = np.zeros(len(new), np.int64), [known[5]], len(known[5])
    for n in np.unique(size[new]):
        rows = np.flatnonzero(size[new] == n)
        if n <= LONG:
            best[rows], second[rows], got, many, char = _columns(p, joined[start[new[rows]][:, None] + np.arange(n)])
            if (got < 0).any():
                spelled = [p.spelled(k, chr(c)) for k, c in zip(got.tolist(), char.tolist())]
                owner = np.repeat(np.repeat(np.arange(len(rows)), many), [len(x) for x in spelled])
                got, many = np.concatenate([np.array(x, np.int64) for x in spelled]), np.bincount(owner, minlength=len(rows))
        else:
            tops = [p.n_best(_text(joined[start[r]:start[r] + n]), 2) for r in new[rows].tolist()]
            best[rows] = [t[0][0] for t in tops]
            second[rows] = [t[1][0] if len(t) > 1 else NEG for t in tops]
            got, many = np.concatenate([np.array(t[0][1], np.int64) for t in tops]), np.array([len(t[0][1]) for t in tops])
        lens[rows], place[rows] = many, base + np.cumsum(many) - many
        parts.append(got)
        base += len(got)
    where = np.searchsorted(old, keys[new])
    p.known = known = tuple(np.insert(x, where, y) for x, y in zip(known[:5], (keys[new], best, second, place, lens))) + (np.concatenate(parts),)
    at = np.searchsorted(known[0], keys)
    return *(x[at] for x in known[1:5]), known[5]


def _nothing() -> tuple:
    return np.zeros(0, U64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)


def _encode(p: Pieces, texts: list[str], n: int):
    """For each text its best ids, its score and, for ``n > 1``, its ``n`` best ``(score, ids)``."""
    ready = [BLANK + t.replace(BLANK, _LITERAL).replace(" ", BLANK) if t else "" for t in texts]
    joined = np.frombuffer("".join(ready).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in ready])]).astype(np.int64)
    if not len(joined):
        return [(np.zeros(0, np.int64), 0.0, [(0.0, np.zeros(0, np.int64))]) for _ in texts]
    place = p.place[joined]
    cut = np.ones(len(joined), bool)
    cut[1:] = ~p.pairs[place[:-1], place[1:]]
    cut[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(joined))
    per_text = np.searchsorted(starts, bounds)
    # one search for equal chunks
    h = np.zeros(len(starts), U64)
    sizes = ends - starts
    total = np.zeros(len(joined) + 1, U64)
    power = _powers(len(joined))
    np.cumsum((joined.astype(U64) + U64(1)) * power[0], out=total[1:])
    h = mix((total[ends] - total[starts]) * power[1][starts] + sizes.astype(U64) * _P)
    keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    u_start, u_size = starts[first], sizes[first]
    best, second, at, lens, flat = _searched(p, keys, u_start, u_size, joined)
    width = lens[inverse]
    ends_of = np.cumsum(width)
    whole = flat[np.arange(ends_of[-1]) + np.repeat(at[inverse] - (ends_of - width), width)]
    id_bounds = np.concatenate([[0], ends_of])[per_text]
    scores = seg_sum(best[inverse], per_text)
    loss = (best - second)[inverse]
    out = []
    memory: dict[int, list] = {}
    for d in range(len(texts)):
        mine = whole[id_bounds[d]:id_bounds[d + 1]]
        tops = [(float(scores[d]), mine)]
        lo, hi = int(per_text[d]), int(per_text[d + 1])
        if n > 1 and hi > lo:
            near = loss[lo:hi]
            some = np.argpartition(near, n - 1)[:n - 1] if hi - lo >= n else np.arange(hi - lo)
            some = np.sort(some[near[some] < 1e29]) + lo
            ranked: list[tuple[float, tuple]] = [(0.0, ())]
            for k in some.tolist():
                u = int(inverse[k])
                if u not in memory:
                    memory[u] = p.n_best(_text(joined[u_start[u]:u_start[u] + u_size[u]]), n)
                ranked = heapq.nsmallest(n, ((cost + memory[u][0][0] - s, (*how, (k, x))) for cost, how in ranked for s, x in memory[u]), key=lambda r: r[0])
            for cost, how in ranked[1:]:
                parts, prev = [], lo
                for k, x in how:
                    parts += [whole[ends_of[prev] - width[prev]:ends_of[k] - width[k]] if k > prev else whole[:0], np.array(x, np.int64)]
                    prev = k + 1
                parts.append(whole[ends_of[prev] - width[prev]:id_bounds[d + 1]] if prev < hi else whole[:0])
                tops.append((float(scores[d]) - cost, np.concatenate(parts)))
        out.append((mine, float(scores[d]), tops))
    return out


_POWERS: list = []


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0][0]) < size:
        p, q = np.full(size, _P, U64), np.full(size, U64(pow(int(_P), -1, 1 << 64)), U64)
        p[:1] = q[:1] = 1
        _POWERS[:] = [(np.multiply.accumulate(p), np.multiply.accumulate(q))]
    return _POWERS[0][0][:size], _POWERS[0][1][:size]


def _text(codes: np.ndarray) -> str:
    return codes.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


def _groups(column: pa.Array):
    texts, held, size = column.to_pylist(), [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


_LOADED: dict = {}


def _pieces(model: bytes) -> Pieces:
    key = hashlib.sha256(model).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


#: Segmentations of a text that the queries ask for.
N_BEST = 4


def encode(docs: DataFrame, model: bytes, n: int = 1) -> DataFrame:
    """``(doc_id, ids, score, n_best, round_trip)`` for every row of ``docs (doc_id, text)``.

    ``ids`` is the best segmentation; ``n_best`` holds the best ``n`` as
    ``(score, ids)``, best first, fewer if there are no more, and is null for
    ``n = 1``; ``round_trip`` tells whether all of them decode to the text. Null and empty
    texts have no ids and a score of 0. Characters that no piece covers are
    written as their UTF-8 bytes, and so is a ``▁`` of the text itself, so
    :func:`decode` gives back every text. Of segmentations with the same
    score, the one whose last differing piece is longest comes first in
    ``ids``. ``model`` is the content of a SentencePiece model file (size
    fixed by the vocabulary) and is broadcast. An empty table gives no rows;
    repeated rows repeat; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        p = _pieces(shared.value)
        kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))

        def lists(sizes, values):
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)

        for batch in batches:
            at = 0
            for texts in _groups(batch.column("text")):
                got = _encode(p, texts, n)
                ids = lists([len(x) for x, *_ in got], pa.array(np.concatenate([x for x, *_ in got]).astype(np.int32)))
                tops = pa.nulls(len(got), kind)
                if n > 1:
                    each = [x for *_, t in got for _, x in t]
                    pairs = pa.StructArray.from_arrays([pa.array([s for *_, t in got for s, _ in t], pa.float64()), lists([len(x) for x in each], pa.array(np.concatenate(each).astype(np.int32)))], ["score", "ids"])
                    tops = lists([len(t) for *_, t in got], pairs)
                same = pa.array([all(p.decode(x) == r for _, x in t) for r, (*_, t) in zip((t.encode("utf-8", "surrogatepass") for t in texts), got)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(got)), ids, pa.array([s for _, s, _ in got]), tops, same], ["doc_id", "ids", "score", "n_best", "round_trip"])
                at += len(got)

    return keyed(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, score double, n_best array<struct<score:double,ids:array<int>>>, round_trip boolean")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """``(doc_id, text)`` of ``encoded (doc_id, ids)``; null ids give an empty text, bytes that are not UTF-8 give U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        p = _pieces(shared.value)
        for batch in batches:
            texts = [p.decode(np.array(x if x is not None else [], np.int64)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def encoding_report(docs: DataFrame, model: bytes, n: int = N_BEST) -> DataFrame:
    """``(doc_id, n_ids, score, ids_sha256, n_best_scores, n_best_sha256, round_trip)``: digests of :func:`encode` in one pass.

    The digests are over the ids as little-endian 4-byte integers, for
    ``n_best_sha256`` one segmentation after another. ``round_trip`` tells
    whether every segmentation decodes to the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        p = _pieces(shared.value)
        for batch in batches:
            at = 0
            for texts in _groups(batch.column("text")):
                got = _encode(p, texts, n)
                raw = [t.encode("utf-8", "surrogatepass") for t in texts]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(at, len(got)), pa.array([len(x) for x, *_ in got], pa.int64()), pa.array([s for _, s, _ in got]),
                    pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x, *_ in got]),
                    pa.array([[s for s, _ in t] for *_, t in got], pa.list_(pa.float64())),
                    pa.array([hashlib.sha256(b"".join(x.astype("<i4").tobytes() for _, x in t)).hexdigest() for *_, t in got]),
                    pa.array([all(p.decode(x) == r for _, x in t) for r, (*_, t) in zip(raw, got)])],
                    ["doc_id", "n_ids", "score", "ids_sha256", "n_best_scores", "n_best_sha256", "round_trip"])
                at += len(got)

    return keyed(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, score double, ids_sha256 string, n_best_scores array<double>, n_best_sha256 string, round_trip boolean")
