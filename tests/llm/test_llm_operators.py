"""The operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from clickpath.llm import cap_dedup, decontaminate, graph, langid_nb, masked_lm, phrase_dedup, pii_crf, queries, repeats, sentencepiece_nbest, simhash_cover, suffix_dedup, textops, toxicity_mil

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n "), (None, "no id here at all"), (5, "x" * 30000), (6, "same text again and again " * 40), (7, "same text again and again " * 40), (7, "same text again and again " * 40)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, copies, a repeated row, and columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "s", 1, 2, 3, "z") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id long, anchor long, starts long, fp string")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = random.Random(5)
    rows += [(10000 + k, "a" * rng.randint(0, 300) + " " + "x y " * rng.randint(0, 50)) for k in range(15)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def _empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_simhash_matches_brute_force(docs):
    rows, df = docs

    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = np.array([fp(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    label = np.array([i for i, _ in rows])
    while True:
        new = np.where(near, label[None, :], 1 << 60).min(1)
        if (new == label).all():
            break
        label = new
    want = {i: (format(int(x), "016x"), int(c)) for (i, _), x, c in zip(rows, prints, label)}
    assert {r[0]: (r[1], r[2]) for r in simhash_cover.simhash_groups(df).collect()} == want
    kept = {r["doc_id"] for r in simhash_cover.simhash_keep(df).collect()}
    assert kept == {int(c) for c in label}


def test_covering_masks_cover():
    rng = random.Random(1)
    masks = simhash_cover.masks()
    assert len(masks) == 15
    for _ in range(2000):
        bits = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(m & bits == 0 for m in masks)


def test_simhash_odd_rows(odd, spark):
    got = [(r[0], r[1], r[2]) for r in simhash_cover.simhash_groups(odd).collect()]
    assert len(got) == len(ODD)
    by_id = {i: c for i, _, c in got}
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[7] == 6 and by_id[None] is None
    kept = simhash_cover.simhash_keep(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 5, 6]
    assert simhash_cover.simhash_groups(_empty(spark)).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(20, 60)] + [(5, 9), (9, 7), (3, 3), (None, 4)]
    got = dict(map(tuple, graph.components(spark, spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{k: 20 for k in range(21, 61)}, 7: 5, 9: 5}


def test_cap_filters_find_the_links(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((150, 64))
    near = base[:60] + 0.3 * rng.standard_normal((60, 64)) * np.linspace(0.2, 1.2, 60)[:, None]
    hot = base[0] + 0.05 * rng.standard_normal((700, 64))  # a cluster larger than a block
    x = np.concatenate([base, near, hot, base[:5]])
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    odd_rows = [(9001, None), (9002, []), (9003, [0.0] * 64), (9004, [float("nan")] + [1.0] * 63), (9005, [1.0, 2.0]), (9006, [2.0, 4.0]), (9007, [None] * 64)]
    got = {r["vec_id"]: r for r in cap_dedup.near_vectors(spark.createDataFrame(rows + odd_rows, "vec_id long, embedding array<double>")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    assert sum(got[k]["n_links"] for k in range(len(x))) >= 0.99 * links.sum()
    assert all(got[k]["n_links"] <= links[k].sum() for k in range(len(x)))
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(links, label[None, :], 1 << 60).min(1))
        if (new == label).all():
            break
        label = new
    assert np.mean([got[k]["component_id"] == label[k] for k in range(len(x))]) > 0.99
    for k in (9001, 9002, 9003, 9004, 9007):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True)
    assert got[9006]["component_id"] == 9005 and got[9005]["n_links"] == 1
    assert cap_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def _repeats(rows, units, length, later):
    first = {}
    for i, u in rows:
        for k in range(len(u) - length + 1):
            g = u[k:k + length]
            first[g] = min(first.get(g, (i, k)), (i, k))
    out = {}
    for i, u in rows:
        gone = np.zeros(len(u), bool)
        for k in range(len(u) - length + 1):
            if later(first[u[k:k + length]], (i, k)):
                gone[k:k + length] = True
        out[i] = gone
    return out


def test_phrase_dedup_matches_brute_force(docs):
    rows, df = docs
    units = [(i, tuple(re.findall(r"[^\x20\x09-\x0D]+", t))) for i, t in rows]
    gone = _repeats(units, None, 20, lambda f, me: f < me)
    want = {i: (len(u), int(gone[i].sum()), hashlib.sha256(" ".join(w for w, g in zip(u, gone[i]) if not g).encode()).hexdigest()) for i, u in units}
    got = {r[0]: tuple(r)[1:] for r in phrase_dedup.word_report(df).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 1000


def test_suffix_dedup_matches_brute_force(docs):
    rows, df = docs
    units = [(i, t.encode()) for i, t in rows]
    gone = _repeats(units, None, 50, lambda f, me: f[0] < me[0])
    want = {}
    for i, u in units:
        g = gone[i]
        spans = int(np.sum(g[1:] & ~g[:-1]) + (len(g) > 0 and g[0]))
        want[i] = (len(u), int(g.sum()), spans, hashlib.sha256(bytes(b for b, x in zip(u, g) if not x)).hexdigest())
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.byte_report(df).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 10000


def test_gram_hashes_match_one_unit_at_a_time():
    h = np.random.default_rng(1).integers(0, 1 << 63, 400).astype(np.uint64)
    for n in (1, 2, 3, 7, 10, 16, 20, 24, 50):
        for size in (n, n + 1, 400):
            out = np.zeros(size - n + 1, np.uint64)
            for j in range(n):
                out = out * np.uint64(textops._P) + h[j:size - n + 1 + j]
            assert (textops.gram_hashes(h[:size], n) == textops.mix(out)).all()
        assert len(textops.gram_hashes(h[:n - 1], n)) == 0


def test_suffix_solver_sorts_only_anchors_of_several_contexts():
    rng = random.Random(12)
    shared = bytes(rng.randrange(97, 123) for _ in range(70))
    tails = [bytes(rng.randrange(97, 123) for _ in range(30)) for _ in range(4)]
    # anchors 3 and 9 stand alone; the contexts of anchor 5 share windows
    rows = [(3, shared, 40), (5, shared + tails[0], 30), (5, tails[1] + shared, 20), (5, tails[2] * 2, 10), (9, shared[:50], 50)]
    got = {}
    for row, w0, w1, least, *_ in zip(*suffix_dedup.solver(50)(pa.array([c for _, c, _ in rows], pa.binary()), *(np.array(x) for x in ([a for a, *_ in rows], [i for *_, i in rows], [0] * 5, [0] * 5)))):
        got |= {(int(row), w): int(least) for w in range(w0, w1)}
    want = {(r, w): min(i for a, c, i in rows if a == anchor and ctx[w:w + 50] in c) for r, (anchor, ctx, _) in enumerate(rows) for w in range(len(ctx) - 49)}
    assert got == want


def test_dedup_negative_ids(spark):
    # the passage meets twice in one task under positive ids; in the other tasks, once each under negative ids
    rng = random.Random(8)
    own = lambda: " ".join(f"{rng.getrandbits(40):x}" for _ in range(30))
    passage = own()
    rows = [(k, f"{own()} {passage} {own()}") for k in (7, 8)] + [(k, f"{own()} {passage} {own()}") for k in (-5, -1, -(1 << 63), 0)]
    parts = spark.sparkContext.parallelize([rows[:2], *([r] for r in rows[2:])], 5).flatMap(lambda x: x)
    df = spark.createDataFrame(parts, "doc_id long, text string")
    for report, size in ((phrase_dedup.word_report, 30), (suffix_dedup.byte_report, len(passage))):
        gone = {r["doc_id"]: r["n_removed"] for r in report(df).collect()}
        assert gone[-(1 << 63)] == 0
        assert all(size <= gone[k] <= size + 4 for k, _ in rows if k > -(1 << 63)), gone


def test_dedup_lists_anchors_by_text(spark, monkeypatch):
    # pairs of texts without an id share a passage; one row stands many times
    rng = random.Random(9)
    own = lambda: " ".join(f"{rng.getrandbits(40):x}" for _ in range(30))
    rows = [(None, f"{own()} {passage} {own()}") for passage in (own() for _ in range(12)) for _ in range(2)]
    rows += [(7, own())] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sizes, kept = [], repeats.stored

    def stored(spark, df, name):
        out = kept(spark, df, name)
        if name == "recurring":
            sizes.extend(r["n"] for r in out.groupBy(out.columns[0]).agg(F.countDistinct("anchor").alias("n")).collect())
        return out

    monkeypatch.setattr(repeats, "stored", stored)
    for report, shared in ((phrase_dedup.word_report, 12), (suffix_dedup.byte_report, 0)):
        sizes.clear()
        got = report(df).collect()
        assert len(got) == len(rows)
        assert sum(r["n_removed"] > 0 for r in got if r["doc_id"] is None) == shared
        assert not any(r["n_removed"] for r in got if r["doc_id"] == 7)
        # 24 texts in pairs: a text has about a twelfth of the anchors
        assert sum(sizes) > 6 * max(sizes)


def test_interval_expansion_gives_common_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(60):
        parts = [bytes(rng.choice(list(b"ab"), rng.integers(1, 30)).astype(np.uint8)) for _ in range(rng.integers(1, 6))]
        text = np.frombuffer(b"".join(parts), np.uint8)
        cuts = np.cumsum([0] + [len(p) for p in parts])
        ends = np.repeat(cuts[1:], np.diff(cuts))
        order, _, lcp = suffix_dedup.expand(text, ends, 8)
        suffixes = [bytes(text[i:ends[i]]) for i in order]
        for a, b, n in zip(suffixes, suffixes[1:], lcp[1:]):
            common = next((k for k in range(8) if k >= min(len(a), len(b)) or a[k] != b[k]), 8)
            assert n == common


def test_dedup_odd_rows(odd, spark):
    for report in (phrase_dedup.word_report, suffix_dedup.byte_report):
        got = report(odd).collect()
        assert len(got) == len(ODD)
        removed = {(r["doc_id"], r["n_removed"]) for r in got}
        size = 200 if report is phrase_dedup.word_report else len(ODD[-1][1])
        assert (7, size) in removed and (1, 0) in removed and (None, 0) in removed
        assert report(_empty(spark)).count() == 0


def test_decontamination_cases(odd, spark):
    items = [(1, "One two THREE four five six seven eight nine ten eleven"), (20, "again  and"), (3, ""), (4, None), (None, "no id here"), (20, "again and")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = [(100, "x one, two three: four five six seven eight nine ten y"), (101, "one two three four"), (102, "nine ten eleven")]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in decontaminate.contamination(df, bench).collect()}
    assert (got[100]["n_words"], got[100]["n_hit"], got[100]["n_items"]) == (12, 10, 1)
    assert got[100]["items_sha256"] == hashlib.sha256(b"1").hexdigest()
    assert not got[101]["contaminated"] and got[101]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (got[6]["n_hit"], got[6]["n_items"]) == (80, 1)
    assert (got[None]["n_hit"], got[None]["n_items"], got[None]["contaminated"]) == (3, 0, True)
    assert got[1]["n_words"] == 0 and not got[3]["contaminated"]
    blocks = {r["doc_id"]: (r["starts"], r["ends"], r["items"]) for r in decontaminate.benchmark_hits(df, bench, block_bytes=100).collect()}
    assert blocks == {r["doc_id"]: (r["starts"], r["ends"], r["items"]) for r in decontaminate.benchmark_hits(df, bench).collect()}
    kept = decontaminate.remove_contaminated(odd, bench)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 5]
    assert decontaminate.contamination(df, bench.limit(0)).where("contaminated").count() == 0


def _base(text):
    """The patterns as the contract states them."""
    rules = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    out = []
    for k, (kind, rule) in enumerate(rules):
        for m in re.finditer(rule, text):
            digits = "".join(c for c in m.group() if c.isdigit())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and pii_crf.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_patterns_match_plain_regexes():
    rng = random.Random(3)
    for _ in range(8000):
        text = "".join(rng.choice("aB1234 .@+-()_%é0") for _ in range(rng.randint(1, 40)))
        assert pii_crf.patterns(text) == _base(text)


def test_pii_report_and_redaction(odd, spark):
    rows = [(1, "mail é a.b@c.de or call (415) 555-0199 now."), (2, None), (3, "It rained (at last)."), (4, "+1 (988) 555-2485")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    got = {r["doc_id"]: r for r in pii_crf.pii_report(df).collect()}
    assert (got[1]["n_email"], got[4]["n_phone"], got[3]["spans"]) == (1, 1, "")
    assert got[1]["spans"] == "email:7:15,phone:24:38" and got[1]["base_sha256"] == hashlib.sha256(b"email:7:15").hexdigest()
    red = {r["doc_id"]: r for r in pii_crf.redact(df).collect()}
    assert red[1]["text"] == "mail é [EMAIL] or call [PHONE] now." and red[1]["n_chars"] == len(red[1]["text"])
    assert red[2]["text"] is None and red[3]["text"] == rows[2][1]
    field = pii_crf.train()
    fits = [(field.decode(f, np.array([0, len(g)])) == g).all() for f, g in pii_crf._labelled()]
    assert np.mean(fits) > 0.9
    assert pii_crf.redact(odd).count() == len(ODD) and pii_crf.pii_report(_empty(spark)).count() == 0


def test_toxicity_held_out(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity_mil.train(docs, labels)
    rows = toxicity_mil.toxicity(docs, model).join(labels, "doc_id").where(toxicity_mil.held_out()).select("predicted", "toxic", "sentences").collect()
    hits = sum(r["predicted"] == r["toxic"] for r in rows)
    found = [r for r in rows if r["toxic"] == 1 and r["predicted"] == 1]
    toxic = sum(r["toxic"] for r in rows)
    clean_kept = sum(r["predicted"] == r["toxic"] == 0 for r in rows)
    assert hits > 0.9 * len(rows) and len(found) >= 0.85 * toxic and clean_kept >= 0.95 * (len(rows) - toxic) and any(r["sentences"] for r in found)
    scores = {r["doc_id"]: r["score"] for r in toxicity_mil.toxicity(odd, model).collect()}
    assert scores[1] == scores[2] == scores[3] == 0 and all(0 <= s <= 1 for s in scores.values())
    kept = toxicity_mil.keep_clean(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    none = toxicity_mil.train(docs, labels.limit(0))
    assert toxicity_mil.toxicity(docs, none).where("predicted = 1").count() == 0


def test_toxicity_cut_is_balanced_and_keeps_the_order():
    rng = np.random.default_rng(4)
    labels = np.repeat([0, 1], [900, 100])
    scores = np.where(labels == 1, rng.beta(2, 8, 1000), rng.beta(1, 60, 1000))
    cut = toxicity_mil.balanced_cut(scores, labels)
    both = lambda c: (scores[labels == 1] >= c).mean() + (scores[labels == 0] < c).mean()
    assert both(cut) > both(0.5) and both(cut) > max(map(both, scores)) - 0.02
    moved = toxicity_mil.Model(np.zeros(1), 0.0, cut).moved(scores)
    assert ((moved >= 0.5) == (scores >= cut)).all() and (np.argsort(moved, kind="stable") == np.argsort(scores, kind="stable")).all()
    assert toxicity_mil.Model(np.zeros(1), 0.0, cut).moved(np.array([0.0, 1.0])).tolist() == [0.0, 1.0]


def test_toxicity_slope_matches_differences(monkeypatch):
    """One step from the start moves every weight against the numerical slope of the loss."""
    rng = np.random.default_rng(6)
    bags = [(rng.integers(0, 12, (9, 2)).astype(np.int32), np.array([0, 4, 9]), int(k % 3 == 0)) for k in range(30)]
    monkeypatch.setattr(toxicity_mil, "LEAST_DOCS", 1)
    start = np.log(np.mean([y for *_, y in bags]) / 2)

    def loss(weights):
        total = 0.0
        for both, bounds, y in bags:
            clean = toxicity_mil._log_clean(toxicity_mil.Model(weights, start).sentences(both, bounds)).sum()
            total -= np.log(-np.expm1(clean)) if y else clean
        return total / len(bags)

    zero = np.zeros(1 << toxicity_mil.BITS)
    step = toxicity_mil.descend(bags, steps=1, rate=1e-3, decay=0.0).weights
    for f in range(12):
        bump = zero.copy()
        bump[f] = 1e-5
        slope = (loss(bump) - loss(-bump)) / 2e-5
        assert abs(slope) < 1e-4 or np.sign(step[f]) == -np.sign(slope)


def test_toxicity_repeated_ids_count_once(spark, monkeypatch):
    rows = [(k, f"text number {k}") for k in range(40)] + [(k, f"copy {n % 3}") for k in (1, 2, 3, 4) for n in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    fitted = []
    monkeypatch.setattr(toxicity_mil, "fit", lambda bags: fitted.append(bags))
    for order in ("text", "doc_id"):
        toxicity_mil.train(docs.orderBy(order), labels)
    want = spark.range(40).withColumnRenamed("id", "doc_id").where(~toxicity_mil.held_out()).count()
    assert len(fitted[0]) == len(fitted[1]) == want
    assert all((a[0] == b[0]).all() and a[2] == b[2] for a, b in zip(*fitted))


def test_language_held_out(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid_nb.train(docs)
    rows = langid_nb.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(langid_nb.held_out()).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) > 0.98 * len(rows)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid_nb.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[6][0] != "und"
    assert langid_nb.identify(odd, langid_nb.train(_empty(spark))).where("lang_pred != 'und'").count() == 0


def test_language_grams_match_plain_counting():
    texts = ["Ab c", "", "É1", "  ", "x"]
    bucket, bounds, has = langid_nb.grams(texts)
    assert has.tolist() == [True, False, True, False, True]
    # letters 1; pairs with the blanks at the ends; triples
    blank = lambda t: " " + "".join(c.lower() if c.isalpha() else " " for c in t) + " "
    for k, t in enumerate(texts):
        b = blank(t)
        want = sum(1 for n in (1, 2, 3) for i in range(len(b) - n + 1) if b[i:i + n].strip() and (n > 1 or True))
        assert abs((bounds[k + 1] - bounds[k]) - want) <= 6


def test_masked_lm_prefers_ordered_text(spark, odd):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rng = random.Random(2)
    good = [(k, " ".join(words * 30)) for k in range(60)]
    bad = [(100 + k, " ".join(rng.sample(words * 30, 240))) for k in range(6)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string").coalesce(2)
    got = {r["doc_id"]: r for r in masked_lm.pseudo_likelihood(df, rounds=4).collect()}
    assert min(got[k]["mean_log_likelihood"] for k in range(60)) > max(got[100 + k]["mean_log_likelihood"] for k in range(6))
    assert got[0]["n_tokens"] == 240
    rows = {r["doc_id"]: r for r in masked_lm.pseudo_likelihood(odd).collect()}
    assert rows[1]["n_tokens"] == 0 and rows[1]["log_likelihood"] == 0 and rows[1]["mean_log_likelihood"] is None
    assert masked_lm.pseudo_likelihood(_empty(spark)).count() == 0


def test_masked_lm_tells_words_of_a_class_apart(spark, monkeypatch):
    rng = random.Random(4)
    common = [f"w{k}" for k in range(masked_lm.FREQUENT)]
    rows = [(k, " ".join(rng.sample(common, len(common)))) for k in range(10)]
    of_class = {}
    for k in range(1000):
        of_class.setdefault(_word_class(f"rare{k}"), []).append(f"rare{k}")
    often, once = max(of_class.values(), key=len)[:2]
    rows += [(100, f"w1 w2 {often} w3 w4"), (101, f"w1 w2 {once} w3 w4"), (102, " ".join([often] * 6)), (None, f"{once}x"), (None, f"{once}y"), (100, f"w1 w2 {often} w3 w4")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scores = []
    # counts held by the tasks, and joined
    for held in (masked_lm.HELD, 0):
        monkeypatch.setattr(masked_lm, "HELD", held)
        got = masked_lm.pseudo_likelihood(df).collect()
        assert len(got) == len(rows)
        one = {r["doc_id"]: r["log_likelihood"] for r in got}
        # the first word stands 8 times in the corpus, the second once
        assert one[100] - one[101] == pytest.approx(np.log(8), abs=1e-5)
        scores.append(sorted(r["log_likelihood"] for r in got))
    assert scores[0] == pytest.approx(scores[1], abs=1e-3)


def _network(seed=3, rows=300):
    rng = np.random.default_rng(seed)
    net = masked_lm.Network((rng.standard_normal(masked_lm._SIZE) * 0.5).astype(np.float32))
    around = rng.integers(0, masked_lm.VOCABULARY + 1, (rows, 2 * masked_lm.WINDOW))
    return net, around, rng.integers(0, masked_lm.VOCABULARY, rows)


def _plain_log_p(net, around, ids):
    """One token after another, in double precision."""
    out = []
    for near, i in zip(around, ids):
        h = np.tanh(sum(net.E[k][a].astype(float) for k, a in enumerate(near)) + net.b)
        group, member = divmod(int(i), masked_lm.MEMBERS)
        both = [(h @ net.V + net.d, group), (h @ net.U[group] + net.c[group], member)]
        out.append(sum(z[c] - np.log(np.exp(z).sum()) for z, c in both))
    return np.array(out)


def test_masked_lm_scores_match_plain_arithmetic():
    net, around, ids = _network()
    assert np.allclose(net.log_p(around, ids), _plain_log_p(net, around, ids), atol=1e-4)
    # probabilities of all classes sum to one
    every = np.arange(masked_lm.VOCABULARY)
    assert np.exp(net.log_p(np.tile(around[0], (len(every), 1)), every).astype(float)).sum() == pytest.approx(1, abs=1e-4)
    assert net.log_p(around[:0], ids[:0]).shape == (0,)


def test_masked_lm_slopes_match_differences():
    net, around, ids = _network(4, 40)
    slope = net.slopes(around, ids).flat
    rng, step = np.random.default_rng(5), 1e-2
    some = np.concatenate([rng.choice(np.flatnonzero(slope), 60), rng.integers(0, masked_lm._SIZE, 20)])
    for at in some:
        moved = []
        for sign in (1, -1):
            flat = net.flat.copy()
            flat[at] += sign * step
            moved.append(-_plain_log_p(masked_lm.Network(flat), around, ids).mean())
        assert slope[at] == pytest.approx((moved[0] - moved[1]) / (2 * step), abs=2e-4)


def test_masked_lm_trains_on_every_position():
    def columns(texts):
        data = [t.encode() for t in texts]
        h, bounds = masked_lm.tokens(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(d) for d in data]))
        return h, bounds

    text = "one two three one two three four " * 50
    h, bounds = columns([text, "other words", "", text])
    for rounds in (1, 2, 5):
        parts = [masked_lm.masked(h, bounds, turn, rounds) for turn in range(rounds)]
        assert sorted(np.concatenate(parts).tolist()) == list(range(len(h)))
        assert min(map(len, parts)) > len(h) / rounds / 3
        # a text is masked alike wherever it stands
        alone = [masked_lm.masked(*columns([text]), turn, rounds) for turn in range(rounds)]
        assert all((p[p >= bounds[3]] - bounds[3]).tolist() == a.tolist() == p[p < bounds[1]].tolist() for p, a in zip(parts, alone))


def _word_class(word):
    """The class of a word beyond the frequent ones."""
    data = np.frombuffer(word.encode(), np.uint8)
    h, _ = masked_lm.tokens(data, np.array([0, len(data)]))
    return int(masked_lm.ids_of(h, np.zeros(0, np.uint64))[0])


@pytest.fixture(scope="module")
def model():
    return queries.tokenizer_model()


def test_n_best_matches_brute_force(model):
    p = sentencepiece_nbest.Pieces(model)

    def every(edges, text, j):
        if j == 0:
            yield 0.0, ()
            return
        for i, k, s in edges[j]:
            for score, ids in every(edges, text, i):
                yield score + s, ids + tuple(p.spelled(k, text[i:j]))

    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice("the andéx1 \n▁") for _ in range(rng.randint(1, 10)))
        ready = sentencepiece_nbest.BLANK + text.replace("▁", sentencepiece_nbest._LITERAL).replace(" ", "▁")
        edges = p.edges(ready)
        want = sorted((s for s, _ in every(edges, ready, len(ready))), reverse=True)[:4]
        (ids, score, tops), = sentencepiece_nbest._encode(p, [text], 4)
        assert [s for s, _ in tops] == want and score == want[0]
        assert all(p.decode(x).decode() == text for _, x in tops)
        assert len({tuple(x) for _, x in tops}) == len(tops)


def test_encoding_round_trip(spark, odd, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (docs, odd):
        enc = sentencepiece_nbest.encode(df, model, 3)
        back = [(r["doc_id"] or -1, r["text"]) for r in sentencepiece_nbest.decode(enc, model).collect()]
        assert sorted(back) == sorted((r["doc_id"] or -1, r["text"] or "") for r in df.collect())
        assert enc.where("ids != n_best[0].ids").count() == 0
    report = sentencepiece_nbest.encoding_report(odd, model)
    assert report.count() == len(ODD) and report.where("not round_trip").count() == 0
    assert sentencepiece_nbest.encode(_empty(spark), model).count() == 0


LAST = (1 << 63) - 1


def test_largest_id_is_an_id_and_not_a_null(spark):
    docs = spark.createDataFrame([(LAST, "one two three four"), (None, "one two three four"), (None, "quite another text here"), (LAST, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash_cover.simhash_groups(docs.where("text is not null")).collect()}
    assert got == {(LAST, LAST), (None, LAST), (None, None)}
    kept = simhash_cover.simhash_keep(docs).collect()
    assert sorted(str(tuple(r)) for r in kept) == sorted(str(x) for x in [(LAST, "one two three four"), (None, "quite another text here"), (LAST, None)])
    vectors = spark.createDataFrame([(LAST, [1.0, 0.0]), (None, [1.0, 0.01]), (None, [0.0, 1.0]), (LAST, None)], "vec_id long, embedding array<double>")
    rows = {(r["vec_id"], r["component_id"], r["n_links"], r["kept"]) for r in cap_dedup.near_vectors(vectors).collect()}
    assert rows == {(LAST, LAST, 1, True), (None, LAST, 1, False), (None, None, 0, True), (LAST, LAST, 0, True)}


def test_simhash_keep_with_clashing_columns_and_a_hot_row(spark):
    rows = [(5, "same text for a third of all", "keep1", 5, "t", "r", True)] * 200 + [(k, f"text {k} of its own with words {k * 7}", f"keep{k}", k, "u", "r", False) for k in range(100, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _n long, _text string, row string, ROW_ boolean").repartition(7)
    kept = simhash_cover.simhash_keep(docs)
    assert kept.columns == docs.columns
    got = [tuple(r) for r in kept.collect()]
    assert set(got) <= set(rows) and got.count(rows[0]) == 1
    assert "Window" not in kept._jdf.queryExecution().executedPlan().toString()


def test_items_with_text_ids(spark):
    bench = spark.createDataFrame([("mmlu-1", "alpha beta gamma"), ("mmlu-10", "alpha beta gamma"), (None, "delta epsilon")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "so alpha beta gamma it is"), (2, "delta epsilon"), (3, "clean")], "doc_id long, text string")
    got = {r["doc_id"]: (r["items"], r["starts"]) for r in decontaminate.benchmark_hits(docs, bench).collect()}
    assert got == {1: (["mmlu-1", "mmlu-10"], [1]), 2: ([], [0]), 3: ([], [])}


def test_vectors_in_many_passes_equal_one(spark, monkeypatch):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    one = sorted(tuple(r) for r in cap_dedup.near_vectors(vectors).collect())
    monkeypatch.setattr(cap_dedup, "SENT", 1 << 20)
    assert one == sorted(tuple(r) for r in cap_dedup.near_vectors(vectors).collect())


def test_pii_places_by_plain_counting_and_long_texts():
    field = pii_crf.train()
    one = "é mail jo(at)x(dot)org or (415) 555-0199, card 4111-1111 1111-1111 or a.b@c.de, ip 10.0.0.7 ü. "
    (base, every), (none, found) = pii_crf.spans_of(pa.array([one, None]), field)
    assert none == found == [] and set(base) <= set(every) and len(every) > len(base)
    assert base == _base(one) and all(not any(s < b and e > a for s, _, e in base) for a, k, b in every if (a, k, b) not in base)
    many = 12000  # 1.1 MB with tens of thousands of spans
    start = time.perf_counter()
    (_, long), = pii_crf.spans_of(pa.array([one * many]), field)
    assert time.perf_counter() - start < 60
    assert len(long) == len(every) * many
    assert long[-len(every):] == [(a + len(one) * (many - 1), k, b + len(one) * (many - 1)) for a, k, b in every]


def test_covered_matches_comparing_with_all():
    rng = random.Random(8)
    for _ in range(300):
        spans = [(a, 0, a + rng.randint(1, 9)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 8)))]
        asked = pii_crf._Covered(spans)
        for a in range(60):
            b = a + rng.randint(1, 5)
            assert asked.meets(a, b) == any(s < b and e > a for s, _, e in spans)
