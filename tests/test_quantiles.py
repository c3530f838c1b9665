"""Exact quantiles against numpy, over ties, skew and ten million distinct values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickpath.operators.quality import describe
from clickpath.operators.quantiles import exact_quantiles

PS = (0.0, 0.25, 0.5, 0.731, 0.75, 1.0)


def _cases():
    rng = random.Random(2)
    yield [1.5]
    yield [2.0, None, 1.0]
    yield [rng.choice([0.01, 5.0]) for _ in range(501)]
    yield [rng.gauss(0, 1) for _ in range(999)] + [1e300, -1e300]  # outliers: equal widths would put all into one bucket
    yield [7.0] * 400 + [rng.uniform(0, 100) for _ in range(800)]  # one value holds a third


@pytest.mark.parametrize("values", list(_cases()))
@pytest.mark.parametrize("buckets", [2, 16])
def test_matches_numpy(spark, values, buckets):
    df = spark.createDataFrame([(v, None if v is None else -v) for v in values], "a double, b double").repartition(3)
    got = {(r["column_name"], r["p"]): r["value"] for r in exact_quantiles(df, ["a", "b"], PS, buckets).collect()}
    real = np.array([v for v in values if v is not None])
    for name, x in (("a", real), ("b", -real)):
        assert np.allclose([got[name, p] for p in PS], np.quantile(x, PS), rtol=1e-12)


def test_no_values(spark):
    df = spark.createDataFrame([(None,)], "a decimal(18,2)")
    assert exact_quantiles(df, ["a"], PS).count() == 0
    r = describe(df, "t", ["a"]).first()
    assert r["count"] == 0 and r["p50"] is None and r["mean"] is None


def test_ten_million_distinct_values(spark):
    """Every value occurs once, in scrambled order; no aggregate keeps a column's values in one buffer."""
    n = 10_000_000
    df = spark.range(0, n, 1, 16).select(((F.col("id") * 7_654_321) % n).alias("v"))
    out = exact_quantiles(df, ["v"], (0.25, 0.5, 0.9))
    assert "percentile(" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["p"]: r["value"] for r in out.collect()} == {p: pytest.approx(p * (n - 1), abs=1e-6) for p in (0.25, 0.5, 0.9)}
