"""Landing-page performance: share, funnel, revenue, bounce, device, product mix, trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpath.functions.metrics import MONEY, money_per_unit, month_of, pct, year_of
from clickpath.operators.funnel import active_period, funnel_rates, rate_by, revenue_per, share_of_total
from clickpath.plans.context import Funnel
from clickpath.plans.registry import analysis
from clickpath.spec import PERIOD_AFTER, PERIOD_BEFORE


@analysis("q04_1_landing_share", "A", order=('-Sessions',))
def landing_share(f: Funnel) -> DataFrame:
    """Per landing page: sessions and share of all sessions."""
    g = f.landing.groupBy("Landing_Page").agg(F.count(F.lit(1)).alias("Sessions"))
    return share_of_total(g, "Sessions", "Traffic_Share_Pct")


@analysis("q04_1b_landing_active_period", "A", also=("D",), order=('-Months_Active',))
def landing_active_period(f: Funnel) -> DataFrame:
    """Per landing URL (any view of it): first / last year and month seen, months active."""
    pv = f["pageviews"].filter(F.col("pageview_url").isin(*f.spec.landing_urls))
    return active_period(pv, "pageview_url").select(
        F.col("pageview_url").alias("Landing_Page"),
        F.col("first_year").alias("Launch_Year"), F.col("first_month").alias("Launch_Month"),
        F.col("last_year").alias("Retirement_Year"), F.col("last_month").alias("Retirement_Month"),
        F.col("months").alias("Months_Active"))


@analysis("q04_2_landing_funnel", "A")
def landing_funnel(f: Funnel) -> DataFrame:
    """Per landing page: six step counts and five step rates."""
    counts = {"Sessions": "n", "Saw_Product": "saw_product", "Saw_Cart": "saw_cart",
              "Saw_Shipping": "saw_shipping", "Saw_Billing": "saw_billing", "Orders": "saw_thank_you"}
    return funnel_rates(f.landing, ["Landing_Page"], overall=False, counts=counts)


@analysis("q04_3_landing_order_rate", "A", order=('-Order_Conv_Rate_Pct',))
def landing_order_rate(f: Funnel) -> DataFrame:
    g = f.landing.groupBy("Landing_Page").agg(
        F.count(F.lit(1)).alias("Sessions"), F.sum("saw_thank_you").alias("Orders"))
    return g.select("Landing_Page", "Sessions", "Orders", pct("Orders", "Sessions").alias("Order_Conv_Rate_Pct"))


@analysis("q04_4_landing_revenue", "A", order=('-Total_Revenue',))
def landing_revenue(f: Funnel) -> DataFrame:
    """Per landing page: sessions, revenue, revenue per session."""
    rows = f.landing.select("website_session_id", "Landing_Page").join(
        f.session_funnel.select("website_session_id", "session_revenue"), "website_session_id", "left")
    return revenue_per(rows, ["Landing_Page"])


def _product_mix(f: Funnel) -> DataFrame:
    # Landing label and product label come from the same per-session row, so
    # "landing view ⟕ product view on session" needs no join here.
    return f.flags.select("Landing_Page", "Page_Name",
                          F.when(F.col("Page_Name").isNotNull(), F.col("saw_thank_you")).alias("Purchased"))


@analysis("q04_5_landing_to_product", "A")
def landing_to_product(f: Funnel) -> DataFrame:
    """Landing page × product page: sessions reaching each product (pivoted)."""
    spec = f.spec
    aggs = [F.count(F.when(F.col("Page_Name") == label, 1)).alias(f"{stem}_Sessions")
            for label, stem in zip(spec.product_labels, spec.product_column_stems)]
    return _product_mix(f).groupBy("Landing_Page").agg(*aggs)


@analysis("q04_6_landing_product_conv", "A")
def landing_product_conv(f: Funnel) -> DataFrame:
    """Landing page × product page: purchase % of the sessions reaching each product (pivoted)."""
    spec = f.spec
    aggs, rates = [], []
    for label, stem in zip(spec.product_labels, spec.product_column_stems):
        aggs.append(F.count(F.when(F.col("Page_Name") == label, 1)).alias(f"n_{stem}"))
        aggs.append(F.sum(F.when(F.col("Page_Name") == label, F.col("Purchased"))).alias(f"p_{stem}"))
        rates.append(pct(f"p_{stem}", f"n_{stem}").alias(f"{stem}_Conv_Pct"))
    return _product_mix(f).groupBy("Landing_Page").agg(*aggs).select("Landing_Page", *rates)


@analysis("q04_7_landing_trend", "A", also=("D",), order=('Landing_Page', 'Year', 'Month'))
def landing_trend(f: Funnel) -> DataFrame:
    """Per month of the session start × landing page: five step rates and overall rate."""
    v = f.flags.select(year_of("session_start").alias("Year"), month_of("session_start").alias("Month"),
                       "Landing_Page", "saw_product", "saw_cart", "saw_shipping", "saw_billing", "saw_thank_you")
    return funnel_rates(v, ["Year", "Month", "Landing_Page"], overall=True)


@analysis("q04_8_landing_bounce", "A", order=('-Bounce_Rate_Pct',))
def landing_bounce(f: Funnel) -> DataFrame:
    """Per landing page: sessions that never reached the product listing, and their %."""
    return rate_by(f.landing, ["Landing_Page"], F.col("saw_product") == 0,
                   "Sessions", "Bounced_Sessions", "Bounce_Rate_Pct", hit_value=F.col("website_session_id"))


@analysis("q04_9_landing_device", "A", order=('Landing_Page', 'device_type'))
def landing_device(f: Funnel) -> DataFrame:
    """Landing page × device: sessions, orders, order %, product %, cart %."""
    rows = f.landing.join(f["sessions"].select("website_session_id", "device_type"), "website_session_id")
    g = rows.groupBy("Landing_Page", "device_type").agg(
        F.count(F.lit(1)).alias("Sessions"), F.sum("saw_thank_you").alias("Orders"),
        F.sum("saw_product").alias("sp"), F.sum("saw_cart").alias("sc"))
    return g.select("Landing_Page", "device_type", "Sessions", "Orders",
                    pct("Orders", "Sessions").alias("Order_Conv_Rate_Pct"),
                    pct("sp", "Sessions").alias("Product_Conv_Pct"),
                    pct("sc", "sp").alias("Cart_Conv_Pct"))


@analysis("q04_9b_before_after", "A", also=("D",))
def before_after(f: Funnel) -> DataFrame:
    """Sessions split at ``spec.period_split``: sessions, orders, conversion, revenue, revenue per session."""
    spec = f.spec
    period = F.when(F.col("created_at") < F.lit(spec.period_split).cast("timestamp_ntz"),
                    F.lit(PERIOD_BEFORE)).otherwise(F.lit(PERIOD_AFTER))
    rows = f.session_funnel_with("created_at").select(period.alias("Period"), "saw_thank_you", "session_revenue")
    g = rows.groupBy("Period").agg(
        F.count(F.lit(1)).alias("Sessions"), F.sum("saw_thank_you").alias("Orders"),
        F.sum("session_revenue").cast(MONEY).alias("Total_Revenue"))
    return g.select("Period", "Sessions", "Orders", pct("Orders", "Sessions").alias("Overall_Conv_Rate"),
                    "Total_Revenue", money_per_unit("Total_Revenue", "Sessions").alias("Revenue_Per_Session"))
