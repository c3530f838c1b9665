"""Collated columns: equality, grouping, joins and distinct counts without folding the values."""

from pyspark.sql import functions as F

from clickpath.operators.collation import collated, folded


def test_comparisons_follow_the_collation(spark):
    df = collated(spark.createDataFrame([("/Home", 1), ("/home ", 2), ("/HOME", 3), (" /home", 4), ("/cart", 5), (None, 6)], "url string, n int"), ["url"])
    assert {r["url"]: r["n"] for r in df.groupBy(folded("url").alias("url")).agg(F.sum("n").alias("n")).collect()} == {"/home": 6, " /home": 4, "/cart": 5, None: 6}
    assert df.groupBy("url").count().count() == 4 and df.agg(F.count_distinct("url")).first()[0] == 3
    assert sorted(r["n"] for r in df.where(F.col("url") == "/HOME").collect()) == [1, 2, 3]
    other = spark.createDataFrame([("/hOmE", "h"), ("/CART  ", "c")], "page string, label string")
    joined = df.join(collated(other, ["page"]), F.col("url") == F.col("page"))
    assert sorted((r["n"], r["label"]) for r in joined.collect()) == [(1, "h"), (2, "h"), (3, "h"), (5, "c")]
    assert {r["url"] for r in df.collect()} == {"/Home", "/home ", "/HOME", " /home", "/cart", None}


def test_plain_filters_still_reach_the_scan(spark, scratch):
    spark.createDataFrame([("/Home", 1), ("/cart", 5)], "url string, n int").write.parquet(f"{scratch}/t")
    df = collated(spark.read.parquet(f"{scratch}/t"), ["url"]).where((F.col("url") == "/home") & (F.col("n") < 3))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(n,3)" in plan.split("PushedFilters")[1] and df.count() == 1
