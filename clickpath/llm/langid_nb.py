"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpath.llm.store import keyed
from clickpath.llm.textops import U64, mix, pieces, seg_sum

#: Characters of the n-grams.
SIZES = (1, 2, 3)
BITS = 14
SMOOTH = 0.5
#: Languages at most; with 2**14 buckets the broadcast matrix stays below 70 MB.
MOST_LANGUAGES = 1000
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Lower-case forms of the letters below U+10000, 0 elsewhere; letters beyond stand for themselves."""
    out = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_LETTERS: list[np.ndarray] = []


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of letters, bounds per text, and which texts have a letter.

    Other characters count as one blank, and a blank stands at both ends, so
    word beginnings and ends are n-grams of their own. N-grams of blanks only
    are left out.
    """
    if not _LETTERS:
        _LETTERS.append(_letters())
    joined = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lens + 1)
    small = joined < 1 << 16
    c = np.where(small, _LETTERS[0][np.where(small, joined, 0)], 0)
    for k in np.flatnonzero(~small):
        c[k] = joined[k] if chr(joined[k]).isalpha() else 0
    has = seg_sum((c[1:] != 0).astype(np.int64), np.concatenate([[0], ends])) > 0
    c = c.astype(U64)
    out, at = [], []
    h = np.zeros(len(c), U64)
    filled = np.zeros(len(c), bool)
    for n in range(1, max(SIZES) + 1):
        # h[i]: the n characters from i on
        h = h[:len(c) - n + 1] * U64(0x100000001B3) + c[n - 1:] + U64(1)
        filled = filled[:len(c) - n + 1] | (c[n - 1:] != 0)
        if n in SIZES:
            # a text's own characters and the blanks at its ends; n-grams do not reach beyond
            pos = np.flatnonzero(filled)
            text = np.searchsorted(ends, pos, "right")
            text = np.minimum(text, len(texts) - 1)
            inside = pos + n - 1 <= ends[text]
            pos = pos[inside]
            out.append((mix(h[pos] + U64(n)) >> U64(64 - BITS)).astype(np.int64))
            at.append(text[inside])
    bucket, text = np.concatenate(out), np.concatenate(at)
    order = np.argsort(text, kind="stable")
    return bucket[order], np.searchsorted(text[order], np.arange(len(texts) + 1)), has


def _chunks(column: pa.Array, limit: int = 1 << 18):
    """Ranges of rows with their texts, null as empty."""
    texts = [t or "" for t in column.to_pylist()]
    for i, j in pieces(np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64), limit):
        yield i, j, texts[i:j]


def held_out():
    """crc32 of the id as text modulo 4 is 2; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % 4 == 2


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log-probabilities ``[bucket, language]`` with the log-priors as last row.

    Counts cover the whole text of every row with a language that is not held
    out. Each task sums its own counts per language, the sums are added up by
    Spark, and the driver gets one number per language and bucket.
    """
    base = keyed(docs)
    rows = docs.select(F.col("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & ~held_out())
    langs = sorted(r[0] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not langs:
        return [], np.zeros(((1 << BITS) + 1, 0), np.float32)
    del base
    index = {x: k for k, x in enumerate(langs)}

    def run(batches):
        counts = np.zeros((len(langs), (1 << BITS) + 1), np.int64)
        for batch in batches:
            lang = np.array([index[x] for x in batch.column("lang").to_pylist()], np.int64)
            np.add.at(counts[:, -1], lang, 1)
            for i, j, texts in _chunks(batch.column("text")):
                bucket, bounds, _ = grams(texts)
                code = np.repeat(lang[i:j], np.diff(bounds)) * (1 << BITS) + bucket
                counts[:, :-1] += np.bincount(code, minlength=len(langs) << BITS).reshape(len(langs), -1)
        k, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[k, b])], ["k", "b", "n"])

    summed = rows.mapInArrow(run, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(langs), (1 << BITS) + 1))
    counts[summed["k"], summed["b"]] = summed["n"]
    log_p = np.log(counts[:, :-1] + SMOOTH) - np.log(counts[:, :-1].sum(1, keepdims=True) + SMOOTH * (1 << BITS))
    prior = np.log(counts[:, -1:]) - np.log(counts[:, -1].sum())
    return langs, np.concatenate([log_p, prior], 1).T.astype(np.float32).copy()


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row of ``docs (doc_id, text)``.

    ``score`` is the posterior of the predicted language. Null texts and texts
    without a letter get ``und`` and 0, as does everything if no language was
    learned. Equal posteriors go to the language that sorts first. An empty
    table gives no rows; repeated rows repeat; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        langs, log_p = shared.value
        for batch in batches:
            names, scores = [], []
            for _, _, texts in _chunks(batch.column("text")):
                bucket, bounds, has = grams(texts)
                if not langs:
                    names += [UNKNOWN] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                total = seg_sum(log_p[bucket].astype(np.float64), bounds) + log_p[-1]
                best = total.argmax(1)
                top = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                names += [langs[b] if x else UNKNOWN for b, x in zip(best.tolist(), has.tolist())]
                scores += np.where(has, top, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return keyed(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
