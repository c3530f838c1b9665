"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability of being toxic is a
logistic model over its hashed words and word beginnings; the document's is
the noisy-or of its sentences', ``1 - prod(1 - p)``. Only document labels are
known, and the weights are fitted to them through the noisy-or, which teaches
the model which sentences offend. A quarter of the sample is kept from the
fit; the score at which it is cut best, with both labels counting alike, is
moved to a half.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpath.llm.store import keyed
from clickpath.llm.textops import LOWER, seg_sum, span_hashes, split, table, words

#: Labelled documents that the model is fitted to, at most: those of the smallest hashed ids.
SAMPLE = 6000
BITS = 18
#: Bytes of a word's beginning that count as a feature beside the word.
STEM = 5
#: A feature counts if it occurs in so many documents of the sample.
LEAST_DOCS = 4

_WORD = table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_SENTENCE = ~table(b".!?\n\r|")


def _features(data: np.ndarray, offsets: np.ndarray):
    """Hashed features of each word (two columns), bounds of sentences over words, of texts over sentences, and the sentences' byte spans."""
    data = LOWER[data]
    s_start, s_end, per_text = words(data, offsets, _SENTENCE)
    starts, ends, _ = words(data, offsets, _WORD)
    word = span_hashes(data, starts, ends)
    stem = span_hashes(data, starts, np.minimum(starts + STEM, ends))
    shift = np.uint64(64 - BITS)
    both = np.stack([word >> shift, (stem * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) >> shift], 1).astype(np.int64)
    # words never cross sentences: sentence ends are not word bytes
    return both, np.searchsorted(starts, np.append(s_start, len(data) + 1)), per_text, s_start, s_end


#: Every so many documents of the sample one is kept from the fit, to find the cut.
INNER = 4
#: Documents of each label that the cut needs at least; with fewer it stays at a half.
LEAST_INNER = 10


class Model:
    """Weights of the hashed features, the bias of a sentence, and the raw score that counts as a half."""

    def __init__(self, weights: np.ndarray, bias: float, cut: float = 0.5):
        self.weights, self.bias, self.cut = weights, bias, cut

    def moved(self, score: np.ndarray) -> np.ndarray:
        """The score with its cut at a half; 0, 1 and the order stay."""
        toxic, clean = score * (1 - self.cut), (1 - score) * self.cut
        return toxic / (toxic + clean)

    def sentences(self, both: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log-odds of each sentence; one without words is not toxic at all."""
        return np.where(np.diff(bounds) > 0, self.bias + seg_sum(self.weights[both].sum(1), bounds), -np.inf)


def _log_clean(z: np.ndarray) -> np.ndarray:
    """log(1 - sigmoid(z))."""
    return -np.logaddexp(0, z)


def balanced_cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """The score at which caught toxic and kept clean documents add up to most; the middle of those that are about as good."""
    cuts = np.unique(scores[scores > 0])
    toxic, clean = np.sort(scores[labels == 1]), np.sort(scores[labels == 0])
    sums = 1 - np.searchsorted(toxic, cuts) / len(toxic) + np.searchsorted(clean, cuts) / len(clean)
    good = cuts[sums >= sums.max() - 0.005]
    return float(np.clip(np.exp(np.log(good).mean()), 1e-6, 1 - 1e-6))


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """The model of bags ``(features by word, sentence bounds, label)``, cut on those that it was not fitted to."""
    inner, rest = docs[INNER - 1::INNER], [d for k, d in enumerate(docs) if k % INNER != INNER - 1]
    labels = np.array([y for *_, y in inner])
    if min((labels == 1).sum(), (labels == 0).sum()) < LEAST_INNER or len({y for *_, y in rest}) < 2:
        return descend(docs)
    model = descend(rest)
    scores = np.array([-np.expm1(_log_clean(model.sentences(both, bounds)).sum()) for both, bounds, _ in inner])
    if (scores > 0).any():
        model.cut = balanced_cut(scores, labels)
    return model


def descend(docs: list[tuple[np.ndarray, np.ndarray, int]], steps: int = 250, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Fit by gradient steps (Adam, its rate falling to nothing) on bags.

    Without both labels nothing can be learned, and every text gets the share of label 1.
    """
    labels = np.array([y for *_, y in docs], np.float64)
    if not len(docs) or labels.min() == labels.max():
        return Model(np.zeros(1 << BITS), 40.0 if len(docs) and labels.min() == 1 else -40.0)
    seen = np.zeros(1 << BITS, np.int32)
    for both, _, _ in docs:
        seen[np.unique(both)] += 1
    kept = np.flatnonzero(seen >= min(LEAST_DOCS, len(docs)))
    place = np.full(1 << BITS, len(kept), np.int64)
    place[kept] = np.arange(len(kept))
    sizes = np.concatenate([np.diff(s) for _, s, _ in docs])
    bags = np.concatenate([[0], np.cumsum([len(s) - 1 for _, s, _ in docs])])
    bag_of = np.repeat(np.arange(len(docs)), np.diff(bags))
    # the times of each kept feature in each sentence, document by document
    row, col, times = [], [], []
    for at, (both, bounds, _) in zip(bags.tolist(), docs):
        sent_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        code, n = np.unique(np.concatenate([sent_of, sent_of]) * (len(kept) + 1) + place[np.concatenate([both[:, 0], both[:, 1]])], return_counts=True)
        real = code % (len(kept) + 1) < len(kept)
        row.append((at + code[real] // (len(kept) + 1)).astype(np.int32))
        col.append((code[real] % (len(kept) + 1)).astype(np.int32))
        times.append(n[real].astype(np.float32))
    row, col, times = np.concatenate(row), np.concatenate(col), np.concatenate(times)
    theta = np.zeros(len(kept) + 1)
    theta[-1] = np.log(labels.mean() / max(1.0, np.diff(bags).mean()))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = theta[-1] + np.bincount(row, theta[col] * times, len(sizes))
        clean = np.bincount(bag_of, _log_clean(z), len(docs))
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        toxic = -np.expm1(np.minimum(clean, -1e-9))
        slope = np.where(labels == 1, -np.exp(clean) / toxic, 1.0)[bag_of] * p / len(docs)
        grad = np.append(np.bincount(col, slope[row] * times, len(kept)) + decay * theta[:-1] / 10, slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        theta -= rate * (1 - (t - 1) / steps) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    weights = np.zeros(1 << BITS)
    weights[kept] = theta[:-1]
    return Model(weights, float(theta[-1]))


def held_out(doc_id="doc_id"):
    """crc32 of the id as text modulo 5 is 0; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit to at most ``sample`` labelled documents that are not held out; a document with several labels is toxic if one says so.

    Of rows that share an id, the text of the smallest hash counts. A quarter of the sample, chosen by
    place in the order of ids, only sets the cut (:func:`fit`).
    """
    marked = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y")))
    marked = marked.join(keyed(docs).select("doc_id").distinct(), "doc_id").withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    # the smallest hashes lie below this bound, so that the task which orders them gets about twice the sample however many labels there are
    bound = (1 << 40) * (2 * sample + 1000) // max(1, marked.count())
    chosen = marked.where(F.col("_h") <= bound).orderBy("_h", "doc_id").limit(sample).drop("_h")
    rows = keyed(docs).join(F.broadcast(chosen), "doc_id")
    bags = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"), F.max("y").alias("y")).select("doc_id", "least.text", "y")

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in split(batch.column("text")):
                both, bounds, per_text, _, _ = _features(data, offsets)
                out = []
                for d in range(j - i):
                    b = bounds[per_text[d]:per_text[d + 1] + 1]
                    out.append((batch.column("doc_id")[i + d].as_py(), both[b[0]:b[-1]].astype(np.int32).tobytes(), (b - b[0]).astype(np.int64).tobytes(), batch.column("y")[i + d].as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.int32()))], ["doc_id", "f", "b", "y"])

    rows = bags.mapInArrow(run, "doc_id long, f binary, b binary, y int").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["f"])))
    return fit([(np.frombuffer(r["f"], np.int32).reshape(-1, 2), np.frombuffer(r["b"], np.int64), r["y"]) for r in rows])


def _score(texts: pa.Array, model: Model, spans: bool):
    """Scores of the texts, and their offending sentences as byte spans if asked for."""
    scores, found = np.zeros(len(texts)), [[] for _ in range(len(texts))]
    for i, j, data, offsets in split(texts):
        both, bounds, per_text, s_start, s_end = _features(data, offsets)
        z = model.sentences(both, bounds)
        scores[i:j] = model.moved(np.clip(-np.expm1(seg_sum(_log_clean(z), per_text)), 0, 1))
        if spans:
            for s in np.flatnonzero(z >= np.log(model.cut) - np.log1p(-model.cut)).tolist():
                d = int(np.searchsorted(per_text, s, "right")) - 1
                found[i + d].append((int(s_start[s] - offsets[d]), int(s_end[s] - offsets[d])))
    return np.clip(scores, 0, 1), found


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, predicted, sentences)`` for every row of ``docs (doc_id, text)``.

    ``sentences`` are the offending ones: UTF-8 byte spans ``(start, end)`` of
    sentences that would score a half or more as a document. Null, empty and wordless
    texts have no sentence and score 0. The model (2 MB) is broadcast. An
    empty table gives no rows; repeated rows repeat; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            scores, found = _score(batch.column("text"), shared.value, True)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)),
                                              pa.array([[{"start": a, "end": b} for a, b in x] for x in found], kind)], ["doc_id", "score", "predicted", "sentences"])

    return keyed(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, sentences array<struct<start:long,end:long>>")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a score below a half, with all their columns; one pass, nothing is joined."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            scores, _ = _score(batch.column(batch.schema.get_field_index("text")), shared.value, False)
            out = batch.filter(pa.array(scores < 0.5))
            if out.num_rows:
                yield out

    keyed(docs)
    return docs.mapInArrow(run, docs.schema)
