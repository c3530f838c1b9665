"""Shared report shapes: step rates, revenue per unit, share of total, hit rate, active period.

Each helper aggregates first (partial + final aggregation, one shuffle on the
group keys) and computes rates in a projection over the aggregated columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickpath.functions.metrics import MONEY, money_per_unit, month_diff, pct, year_of

_STEPS = ("saw_product", "saw_cart", "saw_shipping", "saw_billing", "saw_thank_you")
_RATE_NAMES = ("Product_Conv_Pct", "Cart_Conv_Pct", "Shipping_Conv_Pct", "Billing_Conv_Pct", "Purchase_Conv_Pct")


def funnel_rates(df: DataFrame, keys, overall: bool = True, counts: dict | None = None,
                 with_product_step: bool = True) -> DataFrame:
    """Per group: each step as a % of the step before; optional overall % of sessions.

    ``counts`` maps output names for the raw step counts to show, e.g.
    ``{"Sessions": "n", "Orders": "saw_thank_you"}`` (``"n"`` is ``count(*)``).
    Without the product step (product-page sessions), the first rate is cart
    over all rows.
    """
    keys = list(keys)
    steps = _STEPS if with_product_step else _STEPS[1:]
    names = _RATE_NAMES if with_product_step else _RATE_NAMES[1:]
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                              *[F.sum(s).alias(f"sum_{s}") for s in steps])
    dens = ["n"] + [f"sum_{s}" for s in steps[:-1]]
    rates = [pct(f"sum_{s}", d).alias(name) for s, d, name in zip(steps, dens, names)]
    if overall:
        rates.append(pct("sum_saw_thank_you", "n").alias("Overall_Conv_Rate_Pct"))
    shown = []
    for out, src in (counts or {}).items():
        col = "n" if src == "n" else f"sum_{src}"
        shown.append(F.col(col).alias(out))
    return g.select(*keys, *shown, *rates)


def revenue_per(df: DataFrame, keys, revenue: str = "session_revenue",
                units_name: str = "Sessions", total_name: str = "Total_Revenue",
                per_name: str = "Revenue_Per_Session") -> DataFrame:
    """Per group: row count, money total (decimal) and total per row (rounded to the cent)."""
    keys = list(keys)
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(revenue).alias("rev"))
    return g.select(*keys, F.col("n").alias(units_name),
                    F.col("rev").cast(MONEY).alias(total_name),
                    money_per_unit("rev", "n").alias(per_name))


def share_of_total(grouped: DataFrame, count_col: str, pct_name: str) -> DataFrame:
    """Add ``count_col`` as a % of its column total.

    The input is already grouped to a bounded set of dimension values, so the
    one-partition total window runs over a handful of rows, never over facts.
    """
    total = F.sum(count_col).over(Window.partitionBy())
    return grouped.withColumn("_total", total).withColumn(pct_name, pct(count_col, "_total")).drop("_total")


def active_period(df: DataFrame, key: str, ts: str = "created_at") -> DataFrame:
    """Per key: year and month of the first and last time, and month boundaries between them."""
    g = df.groupBy(key).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    return g.select(
        key,
        year_of("_first").alias("first_year"), F.month("_first").cast("bigint").alias("first_month"),
        year_of("_last").alias("last_year"), F.month("_last").cast("bigint").alias("last_month"),
        month_diff("_first", "_last").alias("months"),
    )


__all__ = ["funnel_rates", "revenue_per", "share_of_total", "active_period", "rate_by", "last_event", "MONEY"]


def rate_by(df: DataFrame, keys, hit, total_name: str, hits_name: str, pct_name: str,
            total=None, hit_value=None) -> DataFrame:
    """Per group: rows (or non-NULL ``total``), rows where ``hit`` holds (counting non-NULL
    ``hit_value``, default ``total``), and the hit %."""
    keys = list(keys)
    t = F.count(total) if total is not None else F.count(F.lit(1))
    hit_val = hit_value if hit_value is not None else (total if total is not None else F.lit(1))
    g = df.groupBy(*keys).agg(t.alias(total_name), F.count(F.when(hit, hit_val)).alias(hits_name))
    return g.select(*keys, total_name, hits_name, pct(hits_name, total_name).alias(pct_name))


def last_event(events: DataFrame, key: str, ts: str = "created_at", keep=()) -> DataFrame:
    """Rows at the latest ``ts`` of each ``key``, ties kept (an equality join against the maximum).

    The maximum is an aggregate joined back on (key, time): a key owning a
    large share of the rows is combined map-side, and the join key includes the
    time, so it spreads across tasks.
    """
    latest = events.groupBy(key).agg(F.max(ts).alias(ts))
    return events.select(key, ts, *keep).join(latest, [key, ts])
