"""Pairs of products against plain counting, with wide orders and one that holds a third of all lines."""

import random
from collections import Counter

import pytest

import __spark_entry__ as entry
from clickpath.operators.baskets import basket_pairs
from conftest import SF_SMALL


def _brute(lines):
    orders, total, pairs = {}, Counter(), Counter()
    for order, product, flag in lines:
        total[product] += flag == 1
        if order is not None:
            orders.setdefault(order, []).append((product, flag))
    for items in orders.values():
        first, other = Counter(p for p, f in items if f == 1), Counter(p for p, f in items if f == 0)
        for a, n in first.items():
            for b, m in other.items():
                pairs[a, b] += n * m
    return {(a, b, n, total[a] if a is not None else None) for (a, b), n in pairs.items()}


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_matches_plain_counting(spark, block):
    rng = random.Random(block)
    lines = [(rng.randrange(200), f"p{rng.randrange(30)}", rng.choice([0, 0, 0, 1, None])) for _ in range(1500)]
    lines += [(7, f"p{rng.randrange(300)}", rng.choice([0, 0, 1])) for _ in range(800)]  # a third of all lines
    lines += [(None, "p1", 1), (None, "p2", 0), (9, None, 1), (9, None, 0), (5000, "alone", 1)]
    got = basket_pairs(spark.createDataFrame(lines, "order_id long, product_id string, is_primary_item int").repartition(5), block=block)
    assert {tuple(r) for r in got.collect()} == _brute(lines) and got.count() == len(_brute(lines))


def test_wide_orders_are_split(spark):
    """With 2,000 products in one order and blocks of 100, no group lists more than about a block of each side."""
    from pyspark.sql import functions as F
    lines = spark.range(4000).select(F.lit(1).alias("order_id"), (F.col("id") % 2000).alias("product_id"), (F.col("id") >= 2000).cast("int").alias("is_primary_item"))
    out = basket_pairs(lines, block=100)
    assert out.count() == 2000 * 2000 and out.agg(F.min("times"), F.max("times"), F.max("primary_items")).first() == (1, 1, 1)


def test_basket_scans_the_lines_twice_at_most(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = entry.queries()["q08_1_pairs_c"](spark, SF_SMALL)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    final = plan.split("== Initial Plan ==")[0]
    scans = [x for x in final.splitlines() if "FileScan" in x and "lineitem.parquet" in x]
    assert len(scans) <= 2
