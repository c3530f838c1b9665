"""Data-quality and profiling operators.

Every check is a DataFrame (never a driver-side assertion): a violation count
of 0 means the check passed. Checks over several tables are unions of
one-row aggregates, each a single distributed pass over its table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickpath.operators.quantiles import exact_quantiles


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def null_profile(df: DataFrame, table: str) -> DataFrame:
    """Per column: NULL count and table row count (one aggregate pass, then unpivot)."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count_if(F.col(c).isNull()).alias(f"__n{i}") for i, c in enumerate(cols)])
    pairs = ", ".join(f"'{c}', `__n{i}`" for i, c in enumerate(cols))
    return agg.select(F.lit(table).alias("table_name"),
                      F.expr(f"stack({len(cols)}, {pairs}) AS (column_name, null_count)"),
                      F.col("__rows").alias("row_count"))


def schema_profile(df: DataFrame, table: str) -> list[tuple[str, str, str]]:
    """(table, column, type) from the schema: metadata only, no job."""
    return [(table, f.name, f.dataType.simpleString()) for f in df.schema.fields]


def preview(df: DataFrame, key: str, n: int = 3, last: bool = False) -> DataFrame:
    """First (or last) ``n`` rows by ``key``: a top-k, planned as TakeOrderedAndProject."""
    order = F.col(key).desc() if last else F.col(key).asc()
    return df.orderBy(order).limit(n)


def value_counts(df: DataFrame, col: str, name: str = "n", dropna: bool = True) -> DataFrame:
    """Rows per value; NULL dropped unless ``dropna=False``."""
    src = df.filter(F.col(col).isNotNull()) if dropna else df
    return src.groupBy(col).agg(F.count(F.lit(1)).alias(name))


def distinct_with_null(col: str) -> Column:
    """Distinct values counting NULL as one value (like pandas ``nunique(dropna=False)``)."""
    return F.count_distinct(F.col(col)) + F.max(F.col(col).isNull().cast("int"))


def duplicate_keys(df: DataFrame, table: str, pk: str) -> DataFrame:
    """Rows whose key repeats an earlier row's key (NULL keys equal each other)."""
    return df.agg(F.count(F.lit(1)).alias("rows"), distinct_with_null(pk).alias("keys")).select(
        F.lit(table).alias("table_name"), (F.col("rows") - F.coalesce(F.col("keys"), F.lit(0)))
        .cast("bigint").alias("duplicate_keys"))


def violations(df: DataFrame, check: str, table: str, cond: Column) -> DataFrame:
    """Rows where ``cond`` is not TRUE (a NULL is a violation)."""
    return df.agg(F.count_if(~F.coalesce(cond, F.lit(False))).alias("violations")).select(
        F.lit(check).alias("check"), F.lit(table).alias("table_name"), "violations")


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str, check: str, table: str) -> DataFrame:
    """Child rows whose key has no parent row (left anti join; a NULL key is an orphan)."""
    p = parent.select(F.col(pk).alias("__pk"))
    miss = child.select(fk).join(p, F.col(fk) == F.col("__pk"), "left_anti")
    return miss.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(check).alias("check"), F.lit(table).alias("table_name"), "violations")


def key_overview(df: DataFrame, table: str, pk: str, fk: str | None) -> DataFrame:
    """Rows, column count, distinct primary keys, distinct foreign keys (NULLs not counted).

    One scan and one shuffle: every row gives its keys, each is counted map-side, and the
    counted keys are counted again.
    """
    types = {c: df.schema[c].dataType for c in (pk, fk) if c}
    other = F.lit(None).cast(types[fk]) if fk else F.lit(None).cast("bigint")
    sides = [F.struct(F.lit(0).alias("side"), F.col(pk).alias("pk"), other.alias("fk"))]
    if fk:
        sides.append(F.struct(F.lit(1).alias("side"), F.lit(None).cast(types[pk]).alias("pk"), F.col(fk).alias("fk")))
    keys = df.select(F.inline(F.array(*sides))).groupBy("side", "pk", "fk").agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(F.coalesce(F.sum(F.when(F.col("side") == 0, F.col("n"))), F.lit(0)).alias("row_count"),
                    F.count("pk").alias("pk_distinct"), F.count("fk").alias("fk_distinct")).select(
        F.lit(table).alias("table_name"), "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        "pk_distinct", ("fk_distinct" if fk else F.lit(None).cast("bigint").alias("fk_distinct")))


def describe(df: DataFrame, table: str, cols) -> DataFrame:
    """count, mean, std (sample), min, 25/50/75 % (exact, interpolated), max per money column.

    Sums run on exact integer cents, so mean and std do not depend on the
    summation order. One scan gives the sums of all columns, one the exact
    quantiles (:func:`clickpath.operators.quantiles.exact_quantiles`).
    """
    moments = []
    for k, c in enumerate(cols):
        cents = (F.col(c) * 100).cast("decimal(38,0)")
        moments += [F.count(c).alias(f"n{k}"), F.sum(cents).alias(f"s{k}"), F.sum(cents * cents).alias(f"q{k}"),
                    F.min(c).cast("double").alias(f"lo{k}"), F.max(c).cast("double").alias(f"hi{k}")]
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{m}{k}").alias(m) for m in ("n", "s", "q", "lo", "hi")])
                              for k, c in enumerate(cols)]))
    sums = df.agg(*moments).select(rows)
    at = lambda p: F.round(F.max(F.when(F.col("p") == p, F.col("value"))), 2)
    quantiles = exact_quantiles(df, cols, (0.25, 0.5, 0.75)).groupBy("column_name").agg(at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"))
    n = F.col("n")
    return sums.join(quantiles, "column_name", "left").select(
        F.lit(table).alias("table_name"), "column_name", n.alias("count"),
        (F.col("s").cast("double") / F.nullif(n, F.lit(0)).cast("double") / 100).alias("mean"),
        (F.sqrt((n * F.col("q") - F.col("s") * F.col("s")).cast("double") / F.nullif(n * (n - 1), F.lit(0)).cast("double")) / 100).alias("std"),
        F.col("lo").alias("min"), "p25", "p50", "p75", F.col("hi").alias("max"))
