"""Derived metrics and opportunity sizing behind the published figures.

Every sizing takes its assumptions (uplift, factor, recovery rate, target
rate, period) as explicit arguments. Money results are computed in integer
cents with one final half-up rounding, so they are exact and identical on
any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickpath.functions.metrics import (
    MONEY, day_diff, money_pct, money_per_unit, month_diff, month_floor, pct,
)
from clickpath.operators.baskets import basket_pairs
from clickpath.operators.funnel import share_of_total
from clickpath.operators.quantiles import exact_quantiles
from clickpath.plans.attribution import _converted
from clickpath.plans.context import Funnel
from clickpath.plans.nonconverters import _non_converter_sessions, non_converter_last_visit
from clickpath.plans.registry import analysis


def _hundredths(num: str, den: str, mult: int = 10000):
    """Integer hundredths of ``num * mult / den / 100`` rounded half up (percent: mult=10000)."""
    return F.expr(f"(abs(`{num}`) * {2 * mult} + nullif(`{den}`, 0)) div (2 * nullif(`{den}`, 0))"
                  ).cast("bigint") * F.expr(f"CAST(sign(`{num}`) AS BIGINT)")


def _cents_from(factors: list, divisor: int):
    """Half-up ``prod(factors) / divisor`` for non-negative integral factors, in decimal(38,0)."""
    prod = " * ".join([f"CAST({factors[0]} AS DECIMAL(38,0))"] + [str(x) for x in factors[1:]])
    return F.expr(f"({prod} * 2 + {divisor}) div {2 * divisor}")


def _money_cents_per_unit(money_col: str, units: str):
    """Half-up cents of ``money / units`` for a decimal(.,2) money column."""
    return F.expr(f"(abs(CAST(`{money_col}` * 100 AS BIGINT)) * 2 + nullif(`{units}`, 0)) "
                  f"div (2 * nullif(`{units}`, 0))")


@analysis("m_blended_totals", "A", also=("C",))
def blended_totals(f: Funnel) -> DataFrame:
    """Order revenue, gross profit and blended margin over all orders."""
    g = f["orders"].agg(F.sum("price_usd").cast(MONEY).alias("Total_Revenue"),
                        F.sum("gross_profit").cast(MONEY).alias("Total_Gross_Profit"))
    return g.select("Total_Revenue", "Total_Gross_Profit",
                    money_pct("Total_Gross_Profit", "Total_Revenue").alias("Blended_Margin_Pct"))


@analysis("m_product_revenue_share", "A", also=("C",))
def product_revenue_share(f: Funnel) -> DataFrame:
    """Item revenue per product and its share of all item revenue."""
    by_id = f["order_items"].groupBy("product_id").agg(F.sum("price_usd").alias("rev"))
    g = (f["products"].select("product_id", "product_name").join(by_id, "product_id")
         .groupBy("product_name").agg(F.sum("rev").cast(MONEY).alias("Revenue")))
    g = g.withColumn("_total", F.sum("Revenue").over(Window.partitionBy()))
    return g.select(F.col("product_name").alias("Product"), "Revenue",
                    money_pct("Revenue", "_total").alias("Revenue_Share_Pct"))


def _gap_to_best(rates: DataFrame, key: str, rate: str) -> DataFrame:
    best = F.max(rate).over(Window.partitionBy())
    return rates.select(key, rate, F.round(F.col(rate) - best, 2).alias("Gap_To_Best_pp"))


@analysis("m_step_gap_product_cart", "A")
def step_gap_product_cart(f: Funnel) -> DataFrame:
    """Cart rate per product page and its gap to the best page, in percentage points."""
    g = f.product_view.groupBy("Page_Name").agg(F.count(F.lit(1)).alias("n"), F.sum("saw_cart").alias("c"))
    return _gap_to_best(g.select("Page_Name", pct("c", "n").alias("Cart_Conv_Pct")), "Page_Name", "Cart_Conv_Pct")


@analysis("m_step_gap_device_billing", "A")
def step_gap_device_billing(f: Funnel) -> DataFrame:
    """Billing-step rate per device and its gap to the best device, in percentage points."""
    g = f.session_funnel.groupBy("device_type").agg(F.sum("saw_shipping").alias("s"), F.sum("saw_billing").alias("b"))
    return _gap_to_best(g.select("device_type", pct("b", "s").alias("Billing_Conv_Pct")),
                        "device_type", "Billing_Conv_Pct")


@analysis("m_step_gap", "A")
def step_gap(f: Funnel) -> DataFrame:
    """Both published step gaps in one table: cart rate per product page and billing-step
    rate per device, each with its gap to the best segment in percentage points."""
    cart = step_gap_product_cart(f).select(
        F.lit("product_page").alias("dimension"), F.col("Page_Name").alias("segment"), F.lit("cart").alias("step"),
        F.col("Cart_Conv_Pct").alias("Rate_Pct"), "Gap_To_Best_pp")
    billing = step_gap_device_billing(f).select(
        F.lit("device").alias("dimension"), F.col("device_type").alias("segment"), F.lit("billing").alias("step"),
        F.col("Billing_Conv_Pct").alias("Rate_Pct"), "Gap_To_Best_pp")
    return cart.unionByName(billing)


@analysis("m_share_shift", "A", also=("B",))
def share_shift(f: Funnel) -> DataFrame:
    """Per channel: share of converters introduced vs share closed, and the shift."""
    conv = _converted(f)
    first = share_of_total(conv.groupBy(F.col("first_touch_traffic_channel").alias("channel"))
                           .agg(F.count("user_id").alias("first_n")), "first_n", "First_Touch_Share_Pct")
    last = share_of_total(conv.groupBy(F.col("last_touch_traffic_channel").alias("channel"))
                          .agg(F.count("user_id").alias("last_n")), "last_n", "Last_Touch_Share_Pct")
    j = first.join(last, "channel", "full_outer")
    return j.select("channel", "First_Touch_Share_Pct", "Last_Touch_Share_Pct",
                    F.round(F.coalesce("Last_Touch_Share_Pct", F.lit(0.0))
                            - F.coalesce("First_Touch_Share_Pct", F.lit(0.0)), 2).alias("Shift_pp"))


@analysis("m_channel_paths", "A", also=("B",))
def channel_paths(f: Funnel) -> DataFrame:
    """Converters per (first-touch channel, converting channel)."""
    return (_converted(f, "last_touch_traffic_channel")
            .groupBy("first_touch_traffic_channel", "last_touch_traffic_channel")
            .agg(F.count("user_id").alias("Users")))


@analysis("m_median_days", "B")
def median_days(f: Funnel) -> DataFrame:
    """Median calendar days from first touch to the converting session (exact, interpolated)."""
    days = _converted(f).select(day_diff("first_touch_created_at", "last_touch_created_at").alias("d"))
    return exact_quantiles(days, ["d"], [0.5]).agg(F.max("value").alias("Median_Days_To_Convert"))


@analysis("m_device_revenue_share", "A")
def device_revenue_share(f: Funnel) -> DataFrame:
    """Per device: share of sessions and share of revenue."""
    g = f.session_funnel.groupBy("device_type").agg(F.count(F.lit(1)).alias("Sessions"),
                                                    F.sum("session_revenue").cast(MONEY).alias("Revenue"))
    w = Window.partitionBy()
    g = g.withColumn("_s", F.sum("Sessions").over(w)).withColumn("_r", F.sum("Revenue").over(w))
    return g.select("device_type", "Sessions", pct("Sessions", "_s").alias("Session_Share_Pct"),
                    "Revenue", money_pct("Revenue", "_r").alias("Revenue_Share_Pct"))


@analysis("m_never_cart_pct", "A", also=("B",))
def never_cart_pct(f: Funnel) -> DataFrame:
    """Non-converters and the % that never reached the cart (cart counted in sessions, as coded)."""
    m = f.landing.select("website_session_id", "saw_cart")
    g = _non_converter_sessions(f).join(m, "website_session_id", "left").agg(
        F.count_distinct("user_id").alias("Non_Converters"),
        F.count(F.when(F.col("saw_cart") == 1, F.col("user_id"))).alias("Reached_Cart"))
    return g.withColumn("_never", F.col("Non_Converters") - F.col("Reached_Cart")).select(
        "Non_Converters", "Reached_Cart", pct("_never", "Non_Converters").alias("Never_Reached_Cart_Pct"))


@analysis("m_aov_uplift", "A", also=("C",))
def aov_uplift(f: Funnel) -> DataFrame:
    """Average order value of single-item and other orders, and the uplift in %."""
    o = f["orders"].select((F.col("items_purchased") == 1).alias("single"), "price_usd")
    g = o.agg(F.sum(F.when(F.col("single"), F.col("price_usd"))).alias("r1"),
              F.count(F.when(F.col("single"), F.col("price_usd"))).alias("n1"),
              F.sum(F.when(~F.col("single") | F.col("single").isNull(), F.col("price_usd"))).alias("r2"),
              F.count(F.when(~F.col("single") | F.col("single").isNull(), F.col("price_usd"))).alias("n2"))
    g = g.select(money_per_unit("r1", "n1").alias("AOV_Single"), money_per_unit("r2", "n2").alias("AOV_Two"))
    g = g.withColumn("_c1", F.round(F.col("AOV_Single") * 100).cast("bigint")).withColumn(
        "_d", F.round(F.col("AOV_Two") * 100).cast("bigint") - F.col("_c1"))
    return g.select("AOV_Single", "AOV_Two", pct("_d", "_c1").alias("AOV_Uplift_Pct"))


def _landing_perf(f: Funnel) -> DataFrame:
    rows = f.landing.select("website_session_id", "Landing_Page").join(
        f.session_funnel.select("website_session_id", "session_revenue"), "website_session_id", "left")
    return rows.filter(F.col("Landing_Page").isNotNull()).groupBy("Landing_Page").agg(
        F.count(F.lit(1)).alias("Sessions"), F.sum("session_revenue").cast(MONEY).alias("Revenue"))


@analysis("size_foregone_revenue", "A", also=("D",))
def foregone_revenue(f: Funnel) -> DataFrame:
    """Best landing page (revenue per session): monthly revenue over its active months, projected
    over the whole period, minus what it earned. No factor: a historical calculation."""
    perf = _landing_perf(f).withColumn("rps", money_per_unit("Revenue", "Sessions"))
    best = perf.orderBy(F.col("rps").desc(), F.col("Landing_Page")).limit(1)
    label_url = F.create_map(*[x for url, lbl in f.spec.landing_pages for x in (F.lit(lbl), F.lit(url))])
    active = (f["pageviews"].filter(F.col("pageview_url").isin(*f.spec.landing_urls))
              .groupBy("pageview_url").agg(month_diff(F.min("created_at"), F.max("created_at")).alias("Months_Active")))
    period = f["sessions"].agg(month_diff(F.min("created_at"), F.max("created_at")).alias("p")).scalar()
    j = best.withColumn("pageview_url", label_url[F.col("Landing_Page")]).join(active, "pageview_url", "left")
    j = j.withColumn("Monthly_Revenue", (money_per_unit("Revenue", "Months_Active")).cast(MONEY))
    j = j.withColumn("Period_Months", period)
    j = j.withColumn("Full_Period_Revenue", (F.col("Monthly_Revenue") * F.col("Period_Months")).cast(MONEY))
    return j.select("Landing_Page", "Revenue", "Months_Active", "Monthly_Revenue", "Period_Months",
                    "Full_Period_Revenue",
                    (F.col("Full_Period_Revenue") - F.col("Revenue")).cast(MONEY).alias("Foregone_Revenue"))


def _aov_cents(f: Funnel):
    """Average order value in cents (half up), as a scalar subquery."""
    g = f["orders"].agg(F.sum("price_usd").alias("r"), F.count("price_usd").alias("n"))
    return g.select(_money_cents_per_unit("r", "n").alias("aov")).scalar()


@analysis("size_step_uplift", "A")
def step_uplift(f: Funnel, uplift_pp: float = 5.0, factor: float = 0.5, years: int = 1) -> DataFrame:
    """Per product page: sessions × uplift (pp) × downstream completion (purchase / cart) × AOV × factor / years."""
    g = f.product_view.groupBy("Page_Name").agg(F.count(F.lit(1)).alias("Sessions"),
                                                F.sum("saw_cart").alias("c"), F.sum("saw_thank_you").alias("t"))
    u, fa = int(round(uplift_pp * 100)), int(round(factor * 100))
    g = g.withColumn("comp_h", _hundredths("t", "c")).withColumn("aov_c", _aov_cents(f))
    # cents = sessions * (u/100/100) * (comp_h/100/100) * (aov_c) * (fa/100) / years
    est = _cents_from(["Sessions", u, "comp_h", "aov_c", fa], 10 ** 10 * years)
    return g.select("Page_Name", "Sessions", (F.col("comp_h") / 100).alias("Downstream_Completion_Pct"),
                    (F.col("aov_c") / 100).cast(MONEY).alias("AOV"),
                    (est.cast("decimal(38,0)") / 100).cast(MONEY).alias("Estimated_Revenue"))


@analysis("size_device_gap", "A")
def device_gap(f: Funnel, factor: float = 0.5) -> DataFrame:
    """Closing the billing-step gap of each device to the best device: sessions reaching shipping ×
    gap (pp) × purchase after billing × AOV × factor, per year of data."""
    g = f.session_funnel.groupBy("device_type").agg(
        F.sum("saw_shipping").alias("s"), F.sum("saw_billing").alias("b"), F.sum("saw_thank_you").alias("t"))
    g = g.withColumn("bill_h", _hundredths("b", "s")).withColumn("done_h", _hundredths("t", "b"))
    g = g.withColumn("gap_h", F.max("bill_h").over(Window.partitionBy()) - F.col("bill_h"))
    months = f["sessions"].agg((month_diff(F.min("created_at"), F.max("created_at")) + 1).alias("m")).scalar()
    fa = int(round(factor * 100))
    g = g.withColumn("aov_c", _aov_cents(f)).withColumn("months", months)
    # cents per year = s * gap_h/10^4 * done_h/10^4 * aov_c * fa/100 * 12 / months
    est = _cents_from(["s", "gap_h", "done_h", "aov_c", fa, 12], 10 ** 10)   # cents over the period, x12
    g = g.withColumn("_e", est)
    annual = F.expr("(CAST(_e AS DECIMAL(38,0)) * 2 + months) div (2 * months)").cast("decimal(38,0)") / 100
    return g.select("device_type", F.col("s").alias("Shipping_Sessions"), (F.col("gap_h") / 100).alias("Gap_pp"),
                    (F.col("aov_c") / 100).cast(MONEY).alias("AOV"), F.col("months").alias("Period_Months"),
                    annual.cast(MONEY).alias("Annual_Estimate"))


@analysis("size_retarget_pool", "B", also=("A",))
def retarget_pool(f: Funnel, max_days: int = 90, recovery_pct: float = 5.0) -> DataFrame:
    """Non-converters seen within ``max_days`` of the data end × recovery rate × AOV (one-time)."""
    end = f["pageviews"].agg(F.max("created_at")).scalar()
    last = non_converter_last_visit(f)
    days = day_diff(F.col("Last_Visit"), end)
    g = last.agg(F.count_if((days >= 0) & (days <= max_days)).alias("Pool_Users"))
    r = int(round(recovery_pct * 100))
    g = g.withColumn("aov_c", _aov_cents(f))
    est = _cents_from(["Pool_Users", r, "aov_c"], 10 ** 4)
    return g.select("Pool_Users", (F.col("aov_c") / 100).cast(MONEY).alias("AOV"),
                    (est.cast("decimal(38,0)") / 100).cast(MONEY).alias("Estimated_Revenue"))


@analysis("size_cross_sell", "A", also=("C",))
def cross_sell_sizing(f: Funnel, target_pct: float = 30.0) -> DataFrame:
    """Per primary product: primary orders × (target − current two-item rate) × price of its most
    frequent cross-sell product (mean item price)."""
    items = f["order_items"].select("order_id", "product_id", "is_primary_item", "price_usd")
    prim = items.filter(F.col("is_primary_item") == 1).select("order_id", F.col("product_id").alias("pid"))
    o = f["orders"].select("order_id", (F.col("items_purchased") == 2).cast("int").alias("two"))
    per = prim.join(o, "order_id").groupBy("pid").agg(F.count(F.lit(1)).alias("Primary_Orders"),
                                                      F.sum("two").alias("two"))
    pairs = basket_pairs(items).select(F.col("primary").alias("pid"), F.col("further").alias("xid"), F.col("times").alias("n"))
    # most frequent cross-sell product per primary; ties go to the larger id
    top = pairs.groupBy("pid").agg(F.max_by("xid", F.struct("n", "xid")).alias("xid"))
    price = items.groupBy(F.col("product_id").alias("xid")).agg(
        F.sum("price_usd").alias("sp"), F.count("price_usd").alias("np"))
    price = price.select("xid", _money_cents_per_unit("sp", "np").alias("xprice_c"))
    t = int(round(target_pct * 100))
    j = per.join(top, "pid", "left").join(price, "xid", "left")
    j = j.withColumn("cur_h", _hundredths("two", "Primary_Orders"))
    j = j.withColumn("delta_h", F.greatest(F.lit(t) - F.col("cur_h"), F.lit(0)))
    extra_h = _cents_from(["Primary_Orders", "delta_h"], 100)          # extra orders, in hundredths
    j = j.withColumn("extra_h", extra_h)
    est = _cents_from(["extra_h", "xprice_c"], 100)
    return j.select(F.col("pid").alias("Primary_Product_ID"), "Primary_Orders",
                    (F.col("cur_h") / 100).alias("Current_Rate_Pct"),
                    (F.col("extra_h").cast("decimal(38,0)") / 100).cast("decimal(18,2)").alias("Extra_CrossSell_Orders"),
                    F.col("xid").alias("CrossSell_Product_ID"),
                    (F.col("xprice_c") / 100).cast(MONEY).alias("CrossSell_Price"),
                    (est.cast("decimal(38,0)") / 100).cast(MONEY).alias("Estimated_Revenue"))


@analysis("dim_date", "A", also=("B",))
def dim_date(f: Funnel) -> DataFrame:
    """Calendar dates from the first to the last session, with sessions per date (0 when none)."""
    s = f["sessions"].select(F.to_date("created_at").alias("date"))
    bounds = s.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    dates = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("date"))
    counts = s.groupBy("date").agg(F.count(F.lit(1)).alias("sessions"))
    return dates.join(counts, "date", "left").select(
        "date", F.year("date").cast("bigint").alias("year"), F.month("date").cast("bigint").alias("month"),
        F.dayofweek("date").cast("bigint").alias("day_of_week"),
        F.coalesce("sessions", F.lit(0)).cast("bigint").alias("sessions"))


@analysis("m_monthly_growth", "B", also=("A", "D"))
def monthly_growth(f: Funnel) -> DataFrame:
    """Per month: sessions, orders, revenue, orders per session %, and revenue as a multiple of the
    first month's."""
    s = f["sessions"].groupBy(month_floor("created_at").alias("month")).agg(F.count(F.lit(1)).alias("sessions"))
    o = f["orders"].groupBy(month_floor("created_at").alias("month")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("price_usd").cast(MONEY).alias("revenue"))
    j = (s.join(o, "month", "full_outer")
         .withColumn("sessions", F.coalesce("sessions", F.lit(0)))
         .withColumn("orders", F.coalesce("orders", F.lit(0))))
    # months are a bounded dimension: the whole-frame window runs over a few hundred rows
    j = j.withColumn("_first", F.min_by("revenue", "month").over(Window.partitionBy()))
    return j.select("month", "sessions", "orders", "revenue",
                    pct("orders", "sessions").alias("conversion_pct"),
                    money_pct("revenue", "_first").alias("revenue_pct_of_first_month"))
