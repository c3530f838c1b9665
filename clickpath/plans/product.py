"""Product-page funnels: step rates, revenue per visit, order rate, monthly trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpath.functions.metrics import MONEY, money_per_unit, month_of, pct, year_of
from clickpath.operators.funnel import funnel_rates
from clickpath.plans.context import Funnel
from clickpath.plans.registry import analysis

_COUNTS = {"Saw_Product": "n", "Saw_Cart": "saw_cart", "Saw_Shipping": "saw_shipping",
           "Saw_Billing": "saw_billing", "Saw_Thank_You": "saw_thank_you"}


@analysis("q03_1_product_funnel", "A")
def product_funnel(f: Funnel) -> DataFrame:
    """Per product page: step counts and cart / shipping / billing / purchase rates."""
    return funnel_rates(f.product_view, ["Page_Name"], overall=False, counts=_COUNTS,
                        with_product_step=False)


@analysis("q03_2_revenue_per_visit", "A", order=('-Revenue_Per_Page_Visit',))
def revenue_per_visit(f: Funnel) -> DataFrame:
    """Per product page: visits, orders, revenue of those sessions, revenue per visit."""
    visits = f.product_view.select("website_session_id", "Page_Name", "saw_thank_you")
    rev = f.session_funnel.select("website_session_id", "session_revenue")
    g = visits.join(rev, "website_session_id", "left").groupBy("Page_Name").agg(
        F.count(F.lit(1)).alias("Saw_Product"), F.sum("saw_thank_you").alias("Orders"),
        F.sum("session_revenue").cast(MONEY).alias("Total_Revenue"))
    return g.select("Page_Name", "Saw_Product", "Orders", "Total_Revenue",
                    money_per_unit("Total_Revenue", "Saw_Product").alias("Revenue_Per_Page_Visit"))


@analysis("q03_3_product_order_rate", "A", order=('-Session_To_Order_Conv_Pct',))
def product_order_rate(f: Funnel) -> DataFrame:
    """Per product page: visits, orders, visit-to-order %."""
    g = f.product_view.groupBy("Page_Name").agg(
        F.count(F.lit(1)).alias("Saw_Product"), F.sum("saw_thank_you").alias("Orders"))
    return g.select("Page_Name", "Saw_Product", "Orders",
                    pct("Orders", "Saw_Product").alias("Session_To_Order_Conv_Pct"))


@analysis("q03_4_product_funnel_trend", "A", order=('Page_Name', 'Year', 'Month'))
def product_funnel_trend(f: Funnel) -> DataFrame:
    """Per month of the session's first pageview × product page: the four step rates.

    The session start comes from the same per-session aggregate as the flags,
    so no second pass over the pageviews is needed.
    """
    v = (f.flags.filter(F.col("Page_Name").isNotNull())
         .select(year_of("session_start").alias("Year"), month_of("session_start").alias("Month"),
                 "Page_Name", "saw_cart", "saw_shipping", "saw_billing", "saw_thank_you"))
    return funnel_rates(v, ["Year", "Month", "Page_Name"], overall=False, with_product_step=False)
