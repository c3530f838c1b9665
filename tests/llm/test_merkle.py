"""The manifest against a plain Merkle tree and its SQL."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from clickpath.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, h long, steps string"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    code = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return _h(*[code(row[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")])


def _tree(nodes):
    """Root, and for each node the (left, right) siblings of every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, k in zip(paths, at):
            run = nodes[k - k % 3:k - k % 3 + 3]
            p.append(("".join(run[:k % 3]), "".join(run[k % 3 + 1:])))
        nodes = [_h(*nodes[k:k + 3]) for k in range(0, len(nodes), 3)]
        at = [k // 3 for k in at]
    return nodes[0], paths


def _expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r)))
        trees[s] = _tree([_leaf(r) for r in groups[s]])
    root, tops = _tree([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, tops):
        for r, path in zip(groups[s], trees[s][1]):
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            h = _leaf({**r, "text": r["text"].replace("\n", "") if bad and r["text"] is not None else r["text"]})
            for left, right in path + above:
                h = _h(left, h, right)
            out.append((r["doc_id"], _leaf(r), trees[s][0], root, _h(*[a + b for a, b in path + above]), h, h == root))
    return out


def _rows(n, seed, sources):
    rng = random.Random(seed)
    return [dict(doc_id=rng.choice([None, -5, 7]) if rng.random() < 0.1 else k, text=rng.choice([None, "", "a\nb", "plain", "é\n" * 50, "x" * rng.randint(1, 99)]), lang=rng.choice([None, "en"]),
                 source=rng.choice(sources), n_chars=rng.choice([None, k]), t="x", h=1, steps="s") for k in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)


def _sorted(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("n,sources", [(1, ["a"]), (2, ["a"]), (3, ["a", "b"]), (40, [None, "", "b", "é", "Z"]), (300, ["hot"] * 6 + [f"s{k}" for k in range(60)]), (250, ["only"])])
def test_matches_a_plain_tree(spark, n, sources):
    rows = _rows(n, n, sources)
    rows += rows[: n // 4]  # repeated rows
    got = merkle.tamper_report(_frame(spark, rows)).collect()
    assert _sorted(tuple(r) for r in got) == _sorted(_expected(rows))


def test_every_row_a_source(spark):
    rows = [dict(_rows(1, k, ["x"])[0], doc_id=k, source=f"{k:04d}") for k in range(90)]
    assert _sorted(tuple(r) for r in merkle.tamper_report(_frame(spark, rows)).collect()) == _sorted(_expected(rows))


def test_empty_and_long(spark):
    assert merkle.tamper_report(_frame(spark, [])).collect() == []
    rows = [dict(_rows(1, 1, ["x"])[0], doc_id=1, text="line\n" * 400000)]
    assert [tuple(r) for r in merkle.tamper_report(_frame(spark, rows)).collect()] == _expected(rows)


def test_numbering_spreads_a_hot_group(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("s"), (F.col("id") * 7 % 20000).alias("v"), F.lit(1).alias("same"))
    out = merkle.numbered(df, ["s"], ["same"])
    assert out.groupBy("s").agg(F.count_distinct("i").alias("d"), F.max("i").alias("m"), F.max("n").alias("n")).where("d <> n or m <> n - 1").count() == 0
    by_value = merkle.numbered(df, ["s"], ["v"]).alias("a")
    from pyspark.sql import Window
    assert by_value.withColumn("w", F.row_number().over(Window.partitionBy("s").orderBy("v")) - 1).where("w <> i").count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, duck, sf):
    got = queries.op12_merkle_manifest(spark, f"/root/testdata/{sf}")
    cols = sorted(got.columns)
    want = duck(f"/root/testdata/{sf}").execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL['op12_merkle_manifest']})").fetchall()
    assert sorted(tuple(r) for r in got.select(cols).collect()) == sorted(want)
    assert 0.2 < sum(r[cols.index("verified")] for r in want) / len(want) < 1
