"""Exact quantiles without gathering a column.

Values are counted (one row for each distinct value, combined map-side) and
cut into buckets of about equal size by approximate splitters. Prefix sums of
the bucket totals tell which bucket holds each wanted rank, and only in those
few buckets the values are ranked. The splitters only balance the buckets:
whatever they are, the result is exact. No task holds more than one bucket, and
a value that makes up a third of the rows is a single count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a column, a power of two. The distinct values of one bucket are sorted by one task, which can spill.
BUCKETS = 1024


def _bucket(splitters: Column, value: Column, buckets: int) -> Column:
    """How many of the ``buckets - 1`` ascending splitters are at most ``value``, by binary search."""
    steps = [1 << k for k in range(buckets.bit_length() - 2, -1, -1)]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0),
                       lambda found, step: found + F.when(F.get(splitters, found + step - 1) <= value, step).otherwise(0))


def exact_quantiles(df: DataFrame, cols, probabilities, buckets: int = BUCKETS) -> DataFrame:
    """``(column_name, p, value)``: linearly interpolated quantiles of numeric columns as doubles.

    NULLs do not count; a column without values has no rows. One scan serves all columns.
    """
    if buckets < 2 or buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two, 2 at least")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in cols]))
    counts = (df.select(cells.alias("c")).select("c.*").filter(F.col("value").isNotNull())
              .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))
    shares = [k / buckets for k in range(1, buckets)]
    splitters = (counts.groupBy("column_name").agg(F.percentile_approx("value", shares, 20 * buckets).alias("s"))
                 .agg(F.map_from_entries(F.collect_list(F.struct("column_name", "s")))).scalar())
    counts = counts.withColumn("splitters", F.element_at(splitters, F.col("column_name")))
    counts = counts.select("column_name", "value", "n", _bucket(F.col("splitters"), F.col("value"), buckets).alias("bucket"))

    # at most one row for each column and bucket from here to `wanted`
    column = Window.partitionBy("column_name")
    totals = counts.groupBy("column_name", "bucket").agg(F.sum("n").alias("t"))
    totals = totals.select("column_name", "bucket", "t", F.sum("t").over(column).alias("total"), (F.sum("t").over(column.orderBy("bucket")) - F.col("t")).alias("before"))
    wanted = (totals.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
              .withColumn("at", F.col("p") * (F.col("total") - 1))
              .withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
              .filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("t")))
              .select("column_name", "bucket", "before", "p", "at", "rank"))

    ranked = counts.join(wanted.select("column_name", "bucket", "before").distinct(), ["column_name", "bucket"])
    ranked = ranked.withColumn("end", F.col("before") + F.sum("n").over(Window.partitionBy("column_name", "bucket").orderBy("value"))).drop("before")
    hits = ranked.join(wanted.drop("before"), ["column_name", "bucket"]).filter((F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("n")))
    both = hits.groupBy("column_name", "p", "at").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    mixed = (F.ceil("at") - F.col("at")) * F.col("low") + (F.col("at") - F.floor("at")) * F.col("high")
    return both.select("column_name", "p", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(mixed).alias("value"))
