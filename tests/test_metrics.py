"""Numeric contract: exact half-up percents, money ratios, month and day boundaries."""

import decimal

from pyspark.sql import functions as F

from clickpath.functions.metrics import (
    avg_2dp_decimal, day_diff, money_pct, money_per_unit, month_diff, pct,
)
from helpers import ts


def test_pct_half_up_and_null(spark):
    df = spark.createDataFrame([(1005, 100000), (1, 20000), (5, 0), (2, 3), (-1005, 100000)], "n bigint, d bigint")
    got = [r[0] for r in df.select(pct("n", "d")).collect()]
    assert got == [1.01, 0.01, None, 66.67, -1.01]


def test_money_ratios_exact(spark):
    df = spark.createDataFrame([(decimal.Decimal("79.98"), 2, decimal.Decimal("1.005"))],
                               "m decimal(18,2), n bigint, x decimal(18,3)")
    r = df.select(money_per_unit("m", "n").alias("a"), money_pct("m", "m").alias("b")).first()
    assert r.a == 39.99 and r.b == 100.0


def test_avg_decimal_rounds_half_up(spark):
    df = spark.createDataFrame([(3, 2), (1, 3), (2, 0)], "t bigint, c bigint")
    got = [r[0] for r in df.select(avg_2dp_decimal("t", "c")).collect()]
    assert got == [decimal.Decimal("1.50"), decimal.Decimal("0.33"), None]


def test_month_and_day_boundaries(spark):
    df = spark.createDataFrame([(ts("2024-01-31 23:00:00"), ts("2024-02-01 01:00:00"))],
                               "a timestamp_ntz, b timestamp_ntz")
    r = df.select(month_diff("a", "b").alias("m"), day_diff("a", "b").alias("d")).first()
    assert (r.m, r.d) == (1, 1)


def test_integer_division_truncates(spark):
    df = spark.createDataFrame([(7, 2)], "p bigint, m bigint")
    assert df.select(F.expr("p div nullif(m, 0)")).first()[0] == 3


def test_shuffle_partitions_sizing():
    from clickpath.session import shuffle_partitions_for
    assert shuffle_partitions_for(10 * 1024 ** 2) == 200
    assert shuffle_partitions_for(100 * 1024 ** 4) == 409_600
    assert shuffle_partitions_for(10 * 1024 ** 4) == 40_960
