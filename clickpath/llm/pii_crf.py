"""Personal data: fixed patterns, and spans that a linear-chain conditional random field adds.

The patterns find the four kinds as written in full. The field labels the
tokens of each sentence from their word shapes; it is trained on the small
labelled table below and decoded by Viterbi, many sentences at a time. Its
spans are added where they touch no pattern span; the pattern spans stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpath.llm.store import keyed
from clickpath.llm.textops import flat, pieces, table

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# a match starts where a run of digits starts, so the runs need not be tried from every digit
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        hit = _DOMAIN.match(text, at + 1) if start < at else None
        if hit:
            out.append((start, hit.end()))
            last = hit.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    return out


def patterns(text: str) -> list[tuple[int, int, int]]:
    """The pattern spans as ``(start, kind number, end)`` in code points, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


#: The labelled table: kinds in brackets. Fixed values.
LABELLED = (
    "Write to [email jane.doe@mail.example.com] before noon.",
    "Mail [email bob_77@example.org] or [email sales@shop.example.co.uk], please.",
    "The address is [email k.ito.42@mail6.example.com] and it works",
    "Contact [email anna (at) example (dot) com] for details.",
    "Reach us at [email info (at) verein.example (dot) org] any time",
    "Send it to [email tom [at] example [dot] net] today.",
    "Server [ip 192.168.10.24] went down.",
    "Log in from [ip 10.0.0.7] or [ip 172.16.254.1] only",
    "host [ip 39.197.112.39] replied in 12 ms",
    "Blocked [ip 203.0.113.9], see the log.",
    "Pay with [card 4539 1488 0343 6467] at the desk",
    "Card [card 5500-0000-0000-0004] was declined.",
    "number [card 4785380592391139] on file",
    "Her card [card 3782 822463 10005] expires soon.",
    "Call [phone +1 (988) 555-2485] now.",
    "Call [phone (415) 555-0132] after five.",
    "phone [phone +44 20 7946 0958] is the desk",
    "Ring [phone +49-30-901820] or [phone (212) 555-0198] today",
    "dial [phone +1 (724) 555-7058] again",
    "Fax: [phone (303) 555-0147], room 12",
    "Released version 2.0 of the library in 2014.",
    "Licensed under the Apache License, Version 2.0.",
    "The sum was 1,234.56 in 1999 and 12.5 in 2001",
    "See section 3.2.1 and table 4 for 120 rows.",
    "Meet at 10:30 on 2024-01-15 (room 204).",
    "He scored 21-17 and 11-9, then left.",
    "about 3 000 000 people live here (2019)",
    "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"",
    "build 1.2.3-rc4 passed 88 of 90 tests",
    "name | price | 12 | 40 | 7 | total",
    "Isbn 978 was printed in 12 copies (or 13).",
    "We met at home (at last) and left (dot and all).",
    "the price of 5 is 10 + 2 and 3 - 1",
    "# 1 2 3 4 5 6 7 8 9 10 11 12",
    "E = 100; F = 2000; G = 30000",
    "It was a day like any other. Nothing rang.",
    "pages 100-120, 130-145 and 555",
    "Die Zahl 42 (zweiundvierzig) steht auf Seite 7.",
    "Le train part à 18 h 30, quai 5 (gare du Nord).",
    "El 12 de mayo de 2003 llegaron 300 personas.",
    "phone: none, mail: none, card: none",
    "&&& ci%%% $$$ ### 17 %%% ok",
    "id 20231105120000123 and id 77",
    "(555) rows, 0132 columns",
)

LABELS = ["O"] + [f"{b}-{k}" for k in KINDS for b in "BI"]
_WORD = table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_SPACE = table([0x20, *range(0x09, 0x0E)])
_STOP = table(b".!?")
_BITS = 12


def tokenize(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of tokens (runs of letters and digits, or one other byte), and of the sentences over them.

    A sentence ends with its text, at a line end, and after a full stop,
    exclamation or question mark that white space follows.
    """
    word, space = _WORD[data], _SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1] if len(data) else first[:0]
    begin = ~space
    begin[1:] &= ~(word[1:] & word[:-1] & ~first[1:])
    starts = np.flatnonzero(begin)
    after = np.append(starts[1:], len(data)) if len(starts) else starts
    # a token of one byte ends there; a word ends at the first byte that is no word byte
    stop = np.flatnonzero(~word | first)
    nxt = np.searchsorted(stop, starts, "right")
    ends = np.where(word[starts], np.minimum(np.append(stop, len(data))[nxt], after), starts + 1)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[1:] |= data == 0x0A
    cut[1:-1] |= _STOP[data[:-1]] & space[1:]
    edges = np.flatnonzero(cut)
    bounds = np.unique(np.append(np.searchsorted(starts, edges), [0, len(starts)]))
    return starts, ends, bounds


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hashed word-shape features ``[token, feature]``."""
    n = len(starts)
    first = data[starts].astype(np.int64)
    is_word = _WORD[data[starts]]

    def some(inside):
        total = np.concatenate([[0], np.cumsum(inside[data])])
        return (total[ends] - total[starts] > 0).astype(np.int64)

    lower, upper, digit, high = (some(table(r)) for r in (range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), range(0x80, 0x100)))
    length = np.searchsorted([2, 3, 4, 5, 6, 9, 12, 20], ends - starts, "right")
    only_digits = digit * (1 - lower) * (1 - upper) * (1 - high)
    shape = np.where(is_word, lower + 2 * upper + 4 * digit + 8 * high, 16 + first)
    # lengths matter for digits; a word's length says nothing
    size = shape * 16 + np.where(only_digits == 1, length, np.where(is_word, 9, 10))
    glued = np.zeros(n, np.int64)
    glued[1:] = (starts[1:] == ends[:-1])
    value = np.zeros(n, np.int64)
    few = np.flatnonzero(is_word & (ends - starts <= 3) & (digit == 0))
    for k in range(3):
        at = np.minimum(starts[few] + k, len(data) - 1)
        value[few] = value[few] * 256 + np.where(starts[few] + k < ends[few], data[at] | 0x20, 0)
    small = np.isin(value, [int.from_bytes(w.ljust(3, b"\0"), "big") for w in (b"at", b"dot")]) * (1 + (value == int.from_bytes(b"dot", "big")))
    own = size * 3 + small

    def moved(x, step):
        out = np.full(n, -1, np.int64)
        if abs(step) < n:
            if step > 0:
                out[step:] = x[:-step]
            else:
                out[:step] = x[-step:]
        # beyond the sentence stands -1
        sent = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        other = np.full(n, -2)
        if abs(step) < n:
            if step > 0:
                other[step:] = sent[:-step]
            else:
                other[:step] = sent[-step:]
        out[other != sent] = -1
        return out

    p1, n1, p2, n2 = moved(own, 1), moved(own, -1), moved(own, 2), moved(own, -2)
    g1 = moved(glued, -1)
    raw = [own, own * 2 + glued, p1, n1, p1 * 7919 + own, own * 7907 + n1, (p1 * 7919 + own) * 7907 + n1, p2 * 7919 + p1, n1 * 7907 + n2, (own * 2 + glued) * 2 + g1, (p2 * 7919 + p1) * 104729 + own]
    out = np.empty((n, len(raw)), np.int64)
    for k, x in enumerate(raw):
        h = (x.astype(np.uint64) + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k << 57)
        out[:, k] = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - _BITS)
    return out


class Field:
    """Weights of the features by label, and of neighbouring labels."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def decode(self, feats: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The best label of every token, by Viterbi over all sentences at once, the longest ones first."""
        n_labels = len(LABELS)
        labels = np.zeros(len(feats), np.int64)
        emit = np.zeros((len(feats), n_labels), np.float32)
        for k in range(feats.shape[1]):
            emit += self.weights[feats[:, k]]
        sizes = np.diff(bounds)
        order = np.argsort(-sizes, kind="stable")
        sizes, at = sizes[order], bounds[:-1][order]
        sizes, at = sizes[sizes > 0], at[sizes > 0]
        if not len(sizes):
            return labels
        active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
        # emit becomes the best score of any path to a token's label; the way back is read off it
        emit[at] += self.moves[-1]
        score = np.ascontiguousarray(emit[at].T)
        moves = self.moves[:n_labels]
        for t in range(1, int(sizes[0])):
            b = active[t]
            best = score[0, :b] + moves[0][:, None]
            for i in range(1, n_labels):
                np.maximum(best, score[i, :b] + moves[i][:, None], best)
            best += emit[at[:b] + t].T
            emit[at[:b] + t] = best.T
            score = best
        state = np.zeros(len(sizes), np.int64)
        into = np.ascontiguousarray(moves.T)
        for t in range(int(sizes[0]) - 1, -1, -1):
            b, more = active[t], active[t + 1] if t + 1 < len(active) else 0
            if more:
                state[:more] = (emit[at[:more] + t] + into[state[:more]]).argmax(1)
            state[more:b] = emit[at[more:b] + t].argmax(1)
            labels[at[:b] + t] = state[:b]
        return labels


def _allowed() -> np.ndarray:
    """-inf (as -1e4) for an I that follows neither its B nor its I; the last row is a sentence's start."""
    out = np.zeros((len(LABELS) + 1, len(LABELS)), np.float32)
    for j, to in enumerate(LABELS):
        if to[0] == "I":
            for i, frm in enumerate([*LABELS, "O"]):
                if frm[1:] != to[1:] or frm == "O":
                    out[i, j] = -1e4
    return out


def _labelled():
    rows = []
    for line in LABELLED:
        text, spans, at = "", [], 0
        for m in re.finditer(r"\[(email|ip|card|phone) ((?:[^\[\]]|\[at\]|\[dot\])+)\]", line):
            text += line[at:m.start()]
            spans.append((len(text.encode()), len((text + m.group(2)).encode()), KINDS.index(m.group(1))))
            text += m.group(2)
            at = m.end()
        data = np.frombuffer((text + line[at:]).encode(), np.uint8)
        starts, ends, _ = tokenize(data, np.array([0, len(data)]))
        gold = np.zeros(len(starts), np.int64)
        for a, b, k in spans:
            inside = np.flatnonzero((starts >= a) & (ends <= b))
            gold[inside] = 2 + 2 * k
            gold[inside[0]] = 1 + 2 * k
        bounds = np.array([0, len(starts)])
        rows.append((features(data, starts, ends, bounds), gold))
    return rows


def train(steps: int = 120, rate: float = 0.2, decay: float = 0.01) -> Field:
    """Maximum likelihood on the labelled table by Adam; forward-backward gives the expected counts."""
    rows = _labelled()
    n_labels, allowed = len(LABELS), _allowed().astype(np.float64)
    weights, moves = np.zeros((1 << _BITS, n_labels)), np.zeros_like(allowed)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, moves)]

    def lse(x, axis):
        top = x.max(axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))

    for t in range(1, steps + 1):
        gw, gm = decay * weights, decay * moves
        for feats, gold in rows:
            emit, trans = weights[feats].sum(1), moves + allowed
            n = len(gold)
            alpha, beta = np.zeros((n, n_labels)), np.zeros((n, n_labels))
            alpha[0] = emit[0] + trans[-1]
            for k in range(1, n):
                alpha[k] = lse(alpha[k - 1][:, None] + trans[:-1], 0) + emit[k]
            for k in range(n - 2, -1, -1):
                beta[k] = lse(trans[:-1] + (emit[k + 1] + beta[k + 1])[None], 1)
            total = lse(alpha[-1], 0)
            p = np.exp(alpha + beta - total)
            p[np.arange(n), gold] -= 1
            np.add.at(gw, feats.ravel(), np.repeat(p, feats.shape[1], 0))
            gm[-1] += p[0]
            for k in range(1, n):
                gm[:-1] += np.exp(alpha[k - 1][:, None] + trans[:-1] + (emit[k] + beta[k])[None] - total)
                gm[gold[k - 1], gold[k]] -= 1
        for x, g, (m, v) in zip((weights, moves), (gw, gm), state):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return Field(weights.astype(np.float32), (moves + allowed).astype(np.float32))


def _plausible(kind: int, text: str) -> bool:
    """What the field's spans must show beside their shape, so that loose numbers are left alone."""
    digits = sum(c.isdigit() for c in text)
    if kind == 0:
        low = text.lower()
        return "@" in text or (("(at)" in low or "[at]" in low) and ("(dot)" in low or "[dot]" in low))
    if kind == 1:
        parts = text.split(".")
        return len(parts) == 4 and all(x.isascii() and x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == 2:
        return 13 <= digits <= 19 and luhn("".join(c for c in text if c.isdigit() and c.isascii()))
    return 9 <= digits <= 15 and ("(" in text or "+" in text)


_NEEDED = table(b"0123456789@([")


def _worth(data: np.ndarray, starts: np.ndarray, sentences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of sentences that hold a digit, an ``@`` or an opening bracket, and their bounds.

    No span without one of these is plausible (see :func:`_plausible`), so
    the other sentences need no labels: decoding them changes nothing.
    """
    total = np.concatenate([[0], np.cumsum(_NEEDED[data])])
    edge = np.append(starts, len(data))[sentences]
    worth = np.flatnonzero(total[edge[1:]] > total[edge[:-1]])
    size = sentences[worth + 1] - sentences[worth]
    bounds = np.concatenate([[0], np.cumsum(size)])
    return np.arange(bounds[-1]) + np.repeat(sentences[worth] - bounds[:-1], size), bounds


class _Covered:
    """Spans that can be asked whether another one meets any of them, by binary search."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        spans = sorted(spans)
        self.starts = [a for a, _, _ in spans]
        self.reach = list(accumulate((b for _, _, b in spans), max))

    def meets(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.reach[before - 1] > start


def spans_of(column: pa.Array, field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its pattern spans and all its spans, as ``(start, kind number, end)`` in code points."""
    texts = [t or "" for t in column.to_pylist()]
    out = []
    data, offsets = flat(column)
    base = [patterns(t) for t in texts]
    for i, j in pieces(offsets, 1 << 20):
        part, bounds = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        starts, ends, sentences = tokenize(part, bounds)
        labels = np.zeros(len(starts), np.int64)
        rows, some = _worth(part, starts, sentences)
        if len(rows):
            labels[rows] = field.decode(features(part, starts[rows], ends[rows], some), some)
        added: list[list[tuple[int, int, int]]] = [[] for _ in range(j - i)]
        head = np.flatnonzero(labels % 2 == 1)
        inside = (labels > 0) & (labels % 2 == 0)  # the tokens that go on with a span
        stop = np.append(np.flatnonzero(~inside), len(labels))
        last = stop[np.searchsorted(stop, head, "right")] - 1
        doc = np.searchsorted(bounds, starts[head], "right") - 1
        # code points before each byte, so that a span's place costs the same wherever it is in a text
        points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)]) if len(head) else None
        clear: dict[int, _Covered] = {}
        for a, b, d, k in zip(starts[head].tolist(), ends[last].tolist(), doc.tolist(), ((labels[head] - 1) // 2).tolist()):
            begin, end = (int(points[x] - points[bounds[d]]) for x in (a, b))
            if d not in clear:
                clear[d] = _Covered(base[i + d])
            if _plausible(k, bytes(part[a:b]).decode("utf-8", "replace")) and not clear[d].meets(begin, end):
                added[d].append((begin, k, end))
        for d in range(j - i):
            out.append((base[i + d], sorted(base[i + d] + added[d])))
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``(doc_id, spans)`` for every row of ``docs (doc_id, text)``.

    ``spans`` is an array of ``(kind, start, end, base)``, in code points,
    by start and then kind; ``base`` marks the pattern spans. Null and empty
    texts have none; time is linear in the length of a text. The field (0.2 MB) is broadcast. An empty table gives no
    rows; repeated rows repeat; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or train())

    def run(batches):
        for batch in batches:
            rows = []
            for base, every in spans_of(batch.column("text"), shared.value):
                given = set(base)
                rows.append([{"kind": KINDS[k], "start": a, "end": b, "base": (a, k, b) in given} for a, k, b in every])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, _SPANS)], ["doc_id", "spans"])

    return keyed(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def pii_report(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``: counts and digest of the pattern spans, and all spans as text."""
    found = find_pii(docs, field)
    written = lambda x: F.concat_ws(",", F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == F.lit(kind))).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind in brackets; overlapping spans become one. ``n_chars``, if there, follows the text.

    Other columns and rows without spans stay as they are; one pass, nothing is joined.
    """
    keyed(docs)
    shared = docs.sparkSession.sparkContext.broadcast(field or train())
    schema = docs.schema

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, lens = batch.column(at).to_pylist(), {}
            for r, (_, every) in enumerate(spans_of(batch.column(at), shared.value)):
                if every:
                    out, last, text = [], 0, texts[r]
                    for a, k, b in every:
                        if a >= last:
                            out += [text[last:a], f"[{KINDS[k].upper()}]"]
                        last = max(last, b)
                    texts[r] = "".join([*out, text[last:]])
                    lens[r] = len(texts[r])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            size = batch.schema.get_field_index("n_chars")
            if size >= 0 and lens:
                kept = columns[size].to_pylist()
                for r, v in lens.items():
                    kept[r] = v
                columns[size] = pa.array(kept, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)
