"""Column helpers with an exact, engine-independent numeric contract.

Rates are rounded half away from zero to two decimals from *integer* inputs
(counts, or money in cents), so every engine produces the same double:
``round(n * 100 / d, 2)`` is computed as ``((n*20000 + d) div (2*d)) / 100``.
Doing the rounding on binary doubles would make ``1.005`` land on either side
depending on the engine and the summation order.

The helpers take column *names*: rates are always computed in a projection
after the aggregate that produced their inputs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def _q(name: str) -> str:
    return f"`{name}`"


def half_up_ratio(num: str, den: str, mult: int = 10000) -> Column:
    """``round(num * mult / den / 100, 2)`` exactly, as DOUBLE; NULL when den is 0/NULL.

    ``num`` and ``den`` are integral columns (counts, cents). ``mult`` is the
    factor that turns ``num / den`` into hundredths of the result:
    10000 for a percent (n*100/d, two decimals), 1 for cents per unit
    shown in dollars.
    """
    return _ratio_sql(_q(num), _q(den), mult)


def pct(num: str, den: str) -> Column:
    """Percent ``num * 100.0 / NULLIF(den, 0)`` rounded to 2 decimals (half up)."""
    return half_up_ratio(num, den, 10000)


def per_unit(cents: str, units: str) -> Column:
    """Money per unit (``cents`` integral cents) in dollars, rounded to the cent."""
    return half_up_ratio(cents, units, 1)


def _cents_sql(name: str) -> str:
    return f"CAST(`{name}` * 100 AS BIGINT)"


def _ratio_sql(n: str, d: str, mult: int) -> Column:
    return F.expr(
        f"CAST(sign({n}) AS BIGINT) * ((abs({n}) * {2 * mult} + nullif({d}, 0)) "
        f"div (2 * nullif({d}, 0))) / CAST(100 AS DOUBLE)"
    )


def money_per_unit(money_col: str, units: str) -> Column:
    """``round(money / units, 2)`` exactly, for a decimal(.,2) money column and a count."""
    return _ratio_sql(_cents_sql(money_col), _q(units), 1)


def money_pct(num_money: str, den_money: str) -> Column:
    """``round(num / den * 100, 2)`` exactly, for two decimal(.,2) money columns."""
    return _ratio_sql(_cents_sql(num_money), _cents_sql(den_money), 10000)


def to_cents(col) -> Column:
    """Exact integral cents of a decimal(.,2) money column."""
    c = F.col(col) if isinstance(col, str) else col
    return (c * 100).cast("bigint")


def money(col) -> Column:
    """Money column cast to decimal(18,2) (sums are exact in decimal)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast(MONEY)


def avg_2dp_decimal(total: str, count: str) -> Column:
    """``CAST(AVG(x) AS DECIMAL(10,2))`` from an exact integer sum and count."""
    t, c = _q(total), _q(count)
    return F.expr(
        f"CAST(CAST(sign({t}) AS BIGINT) * ((abs({t}) * 200 + nullif({c}, 0)) div (2 * nullif({c}, 0))) "
        f"AS DECIMAL(20,0)) / 100"
    ).cast("decimal(10,2)")


def exact_mean(total: str, count: str) -> Column:
    """Mean as DOUBLE from an exact integer sum and a count (order-independent)."""
    return (F.col(total).cast("double") / F.nullif(F.col(count), F.lit(0)).cast("double"))


def month_diff(start, end) -> Column:
    """Month boundaries crossed from ``start`` to ``end`` (calendar months, not elapsed)."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    return ((F.year(e) - F.year(s)) * 12 + F.month(e) - F.month(s)).cast("bigint")


def day_diff(start, end) -> Column:
    """Midnights crossed from ``start`` to ``end`` (calendar days)."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    return F.datediff(F.to_date(e), F.to_date(s)).cast("bigint")


def year_of(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.year(c).cast("bigint")


def month_of(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.month(c).cast("bigint")


def month_floor(col) -> Column:
    """First day of the month as DATE."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trunc(c, "MM")


def flag(cond: Column) -> Column:
    """0/1 integer flag; NULL conditions count as 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def map_values(col, pairs, default=None) -> Column:
    """Searched CASE mapping ``value -> label``; unmatched -> ``default`` (NULL)."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for value, label in pairs:
        expr = F.when(c == value, F.lit(label)) if expr is None else expr.when(c == value, F.lit(label))
    if default is not None:
        expr = expr.otherwise(F.lit(default))
    return expr
