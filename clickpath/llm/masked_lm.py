"""Document scores by masked pseudo-likelihood.

Every token is predicted from the tokens at both sides by a small window
network with the hidden units ``h = tanh(sum of E[position, neighbour] + b)``.
Its output is a tree of two levels: ``softmax(V h + d)`` chooses a group of
classes, ``softmax(U[group] h + c[group])`` a class of it, so that a prediction
computes 64 numbers instead of 1,024. A document's score is the sum
of the log-probabilities of all its tokens, each given its neighbours.

The vocabulary is every word of the corpus. The network predicts a class, and
``p(word) = p(class) p(word | class)``: the most frequent words are classes of
their own, the others share classes, in which a word's share is its count by
the class's. The counts stay a Spark table; tasks hold those of the more
frequent words, and the rest are joined to the documents. Each training round
masks a share of the positions of every document, and all rounds together each
position once; each task walks through its own documents from the last round's
weights, and Spark averages the tasks' weights by the number of positions they
saw.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpath.llm.store import keyed, stored
from clickpath.llm.textops import LOWER, NOT_SPACE, U64, mix, seg_sum, span_hashes, split, words

#: The most frequent words have a class of their own; the others share these many more by hash.
FREQUENT, SHARED = 768, 256
VOCABULARY = FREQUENT + SHARED
#: Classes of a group, and groups: class ``i`` is in group ``i // MEMBERS``.
MEMBERS = 32
GROUPS = VOCABULARY // MEMBERS
#: Words whose counts every task holds, at most; the counts of all others are joined.
HELD = 1 << 16
#: Neighbours at each side, and hidden units.
WINDOW, HIDDEN = 2, 24
#: Rounds; each position is masked in one of them.
ROUNDS = 2
RATE = 0.08
#: Positions of a training step.
BATCH = 2048
#: Positions scored at once.
SCORED = 4096


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Hashes of the lower-cased words and bounds per text."""
    data = LOWER[data]
    starts, ends, bounds = words(data, offsets, NOT_SPACE)
    return span_hashes(data, starts, ends), bounds


def counted(docs: DataFrame) -> DataFrame:
    """``(h, n)``: how often each word occurs in all documents, stored."""

    def run(batches):
        for batch in batches:
            h = np.concatenate([tokens(data, offsets)[0] for *_, data, offsets in split(batch.column("text"))] or [np.zeros(0, U64)])
            h, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return stored(docs.sparkSession, docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")


def vocabulary(counts: DataFrame) -> np.ndarray:
    """Sorted hashes of the most frequent words of ``counts (h, n)``; equal counts go by hash."""
    top = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    return np.sort(np.array([r["h"] for r in top], np.int64).view(U64))


def within(counts: DataFrame, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logs of the occurrences of each shared class, and sorted hashes of words with the logs of theirs: at most
    ``HELD`` words, all that occur at least some power of two times."""
    shared = counts.where(~F.col("h").isin(vocab.view(np.int64).tolist())).withColumn("power", F.length(F.bin("n")))
    sizes = shared.groupBy(F.col("h").bitwiseAND(SHARED - 1).alias("class"), "power").agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()
    totals, of_power = np.ones(SHARED), np.zeros(65, np.int64)
    for c in range(SHARED):
        totals[c] = max(1, sum(r["n"] for r in sizes if r["class"] == c))
    for r in sizes:
        of_power[r["power"]] += r["words"]
    least = int(np.flatnonzero(np.append(np.cumsum(of_power[::-1])[::-1], 0) <= HELD)[0])
    held = shared.where(F.col("power") >= least).select("h", "n").toPandas()
    h, n = held["h"].to_numpy(np.int64).view(U64), held["n"].to_numpy(np.float64)
    order = np.argsort(h)
    return np.log(totals), h[order], np.log(n[order])


def ids_of(h: np.ndarray, vocab: np.ndarray) -> np.ndarray:
    """Classes of words."""
    at = np.minimum(np.searchsorted(vocab, h), max(0, len(vocab) - 1))
    known = vocab[at] == h if len(vocab) else np.zeros(len(h), bool)
    return np.where(known, at, FREQUENT + (h % U64(SHARED)).astype(np.int64))


def shares(h: np.ndarray, ids: np.ndarray, totals: np.ndarray, held: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-shares of the tokens in their classes, and the places of those whose words are not in ``held``: there, the
    log of the word's count is still to be added."""
    out = np.zeros(len(h))
    places = np.flatnonzero(ids >= FREQUENT)
    out[places] = -totals[ids[places] - FREQUENT]
    if not len(held):
        return out, places
    at = np.minimum(np.searchsorted(held, h[places]), len(held) - 1)
    there = held[at] == h[places]
    out[places[there]] += logs[at[there]]
    return out, places[~there]


def neighbours(ids: np.ndarray, bounds: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``[place, 2 * WINDOW]`` ids around the tokens at ``places``; beyond their text stands ``VOCABULARY``."""
    text = np.searchsorted(bounds, places, "right") - 1
    first, last = bounds[text], bounds[text + 1]
    out = np.full((len(places), 2 * WINDOW), VOCABULARY, np.int64)
    for k, step in enumerate([*range(-WINDOW, 0), *range(1, WINDOW + 1)]):
        at = places + step
        ok = (at >= first) & (at < last)
        out[ok, k] = ids[at[ok]]
    return out


def masked(h: np.ndarray, bounds: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """Places of the tokens that round ``turn`` masks, by the word and its position in its text."""
    position = np.arange(len(h)) - np.repeat(bounds[:-1], np.diff(bounds))
    return np.flatnonzero(mix(h + position.astype(U64) * U64(0x9E3779B97F4A7C15)) % U64(rounds) == U64(turn))


_SHAPES = {"E": (2 * WINDOW, VOCABULARY + 1, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GROUPS), "d": (GROUPS,), "U": (GROUPS, HIDDEN, MEMBERS), "c": (GROUPS, MEMBERS)}
_SIZE = sum(int(np.prod(s)) for s in _SHAPES.values())


class Network:
    """The weights as one vector with named views."""

    def __init__(self, flat: np.ndarray | None = None):
        if flat is None:
            flat = np.random.default_rng(11).standard_normal(_SIZE).astype(np.float32) * np.float32(0.1)
        self.flat, at = flat.astype(np.float32), 0
        for name, shape in _SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, self.flat[at:at + size].reshape(shape))
            at += size

    def hidden(self, around: np.ndarray) -> np.ndarray:
        out = np.tile(self.b, (len(around), 1))
        for k in range(2 * WINDOW):
            out += self.E[k][around[:, k]]
        return np.tanh(out, out)

    def groups(self, hidden: np.ndarray) -> np.ndarray:
        """``[group, row]`` scores; rows stand last, so that sums over the choices add whole rows of numbers."""
        return self.V.T @ hidden.T + self.d[:, None]

    def members(self, hidden: np.ndarray, cuts: list[int]) -> np.ndarray:
        """``[member, row]`` scores of the classes in each row's group; the rows of group ``g`` are ``cuts[g]`` to ``cuts[g + 1]``."""
        z = np.empty((MEMBERS, len(hidden)), np.float32)
        for g, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if j > i:
                np.matmul(self.U[g].T, hidden[i:j].T, out=z[:, i:j])
                z[:, i:j] += self.c[g][:, None]
        return z

    def log_p(self, around: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = np.empty(len(ids), np.float32)
        for i in range(0, len(ids), SCORED):
            order, cuts, group, member = by_group(ids[i:i + SCORED])
            h = self.hidden(around[i:i + SCORED][order])
            out[i + order] = chosen(self.groups(h), group) + chosen(self.members(h, cuts), member)
        return out

    def slopes(self, around: np.ndarray, ids: np.ndarray) -> Network:
        """Of the mean negated log-probability."""
        slope = Network(np.zeros(_SIZE, np.float32))
        order, cuts, group, member = by_group(ids)
        around = around[order]
        h = self.hidden(around)
        z, y = misses(self.groups(h), group), misses(self.members(h, cuts), member)
        slope.V[:], slope.d[:] = (z @ h).T, z.sum(1)
        back = z.T @ self.V.T
        for g, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if j > i:
                slope.U[g], slope.c[g] = (y[:, i:j] @ h[i:j]).T, y[:, i:j].sum(1)
                back[i:j] += y[:, i:j].T @ self.U[g].T
        back *= 1 - h * h
        slope.b[:] = back.sum(0)
        unit, weights = np.arange(HIDDEN), back.ravel().astype(np.float64)
        for k in range(2 * WINDOW):
            cell = (around[:, k, None] * HIDDEN + unit).ravel()
            slope.E[k] = np.bincount(cell, weights, (VOCABULARY + 1) * HIDDEN).reshape(-1, HIDDEN)
        return slope

    def learn(self, around: np.ndarray, ids: np.ndarray, squares: np.ndarray) -> None:
        """One step of Adagrad; ``squares`` are the summed squared slopes."""
        slope = self.slopes(around, ids).flat
        squares += slope ** 2
        self.flat -= RATE * slope / np.sqrt(squares + 1e-8)


def by_group(ids: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray]:
    """The order of classes by group, where each group begins in it, and the groups and members in that order."""
    group, member = ids // MEMBERS, ids % MEMBERS
    order = np.argsort(group.astype(np.int8), kind="stable")
    group = group[order]
    return order, np.searchsorted(group, np.arange(GROUPS + 1)).tolist(), group, member[order]


def chosen(z: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """Log-probabilities of one choice a row, from the ``[choice, row]`` scores of all, which are overwritten."""
    z -= z.max(0)
    own = z[choice, np.arange(len(choice))]
    return own - np.log(np.exp(z, z).sum(0))


def misses(z: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """Probabilities less the choices made, by the number of rows; in place of the scores."""
    z -= z.max(0)
    np.exp(z, z)
    z /= z.sum(0)
    z[choice, np.arange(len(choice))] -= 1
    z /= np.float32(max(1, len(choice)))
    return z


def train(docs: DataFrame, vocab: np.ndarray, rounds: int = ROUNDS) -> Network:
    """Fit on masked positions of all documents, round by round; the driver gets one number per weight."""
    sc = docs.sparkSession.sparkContext
    net = Network()
    for turn in range(rounds):
        shared = sc.broadcast((vocab, net.flat))

        def run(batches, shared=shared, turn=turn):
            known, flat = shared.value
            own, squares, seen = Network(flat.copy()), np.full(_SIZE, 1e-4, np.float32), 0
            for batch in batches:
                for *_, data, offsets in split(batch.column("text")):
                    h, bounds = tokens(data, offsets)
                    ids = ids_of(h, known)
                    at = masked(h, bounds, turn, rounds)
                    around = neighbours(ids, bounds, at)
                    for i in range(0, len(at), BATCH):
                        own.learn(around[i:i + BATCH], ids[at[i:i + BATCH]], squares)
                    seen += len(at)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(_SIZE, dtype=np.int32)), pa.array(own.flat.astype(np.float64) * seen), pa.array(np.full(_SIZE, seen))], ["i", "v", "n"])

        summed = docs.mapInArrow(run, "i int, v double, n long").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).toPandas()
        if len(summed):
            flat = np.zeros(_SIZE, np.float32)
            flat[summed["i"]] = summed["v"]
            net = Network(flat)
    return net


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, n_tokens, log_likelihood, mean_log_likelihood)`` for every row of ``docs (doc_id, text)``.

    Null and blank texts have no tokens, a score of 0 and a null mean. Rows
    that repeat count as often as they occur. An empty table gives no rows;
    other columns are ignored.
    """
    texts = keyed(docs).select("doc_id", "id", "text", F.xxhash64("text").alias("text_hash"))
    spark = docs.sparkSession
    counts = counted(texts.select("text"))
    vocab = vocabulary(counts)
    shared = spark.sparkContext.broadcast((vocab, train(texts.select("text"), vocab, rounds).flat, *within(counts, vocab)))

    def run(batches):
        known, flat, *sizes = shared.value
        net = Network(flat)
        for batch in batches:
            n, score, many = np.zeros(len(batch), np.int64), np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            rest_h, rest_k = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j, data, offsets in split(batch.column("text")):
                h, bounds = tokens(data, offsets)
                ids = ids_of(h, known)
                share, rest = shares(h, ids, *sizes)
                n[i:j] = np.diff(bounds)
                score[i:j] = seg_sum(net.log_p(neighbours(ids, bounds, np.arange(len(ids))), ids).astype(np.float64) + share, bounds)
                if len(rest):
                    # each word once for each text
                    text, word = np.searchsorted(bounds, rest, "right") - 1, h[rest]
                    order = np.lexsort((word, text))
                    text, word = text[order], word[order]
                    new = np.ones(len(word), bool)
                    new[1:] = (text[1:] != text[:-1]) | (word[1:] != word[:-1])
                    first = np.flatnonzero(new)
                    many[i:j] = np.bincount(text[first], minlength=j - i)
                    rest_h.append(word[first].view(np.int64))
                    rest_k.append(np.diff(np.append(first, len(word))))
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(rest_h)), pa.array(np.concatenate(rest_k))], ["h", "k"])
            rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pairs)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "id", "text_hash")), pa.array(n), pa.array(score), rest], ["doc_id", "id", "text_hash", "n_tokens", "score", "rest"])

    rows = stored(spark, texts.mapInArrow(run, "doc_id long, id long, text_hash long, n_tokens long, score double, rest array<struct<h: long, k: long>>"), "scores")
    # rows equal in id and text have the same words
    rest = rows.select("id", "text_hash", F.inline("rest")).groupBy("id", "text_hash", "h").agg(F.max("k").alias("k"))
    more = rest.join(counts, "h").groupBy("id", "text_hash").agg(F.sum(F.col("k") * F.log("n")).alias("more"))
    score = F.col("score") + F.coalesce("more", F.lit(0.0))
    return (rows.drop("rest").join(more, ["id", "text_hash"], "left")
            .select("doc_id", "n_tokens", score.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, score / F.col("n_tokens")).alias("mean_log_likelihood")))
