"""First-touch / converting-touch attribution reports over the user attribution table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpath.functions.metrics import MONEY, day_diff, exact_mean, money_per_unit, pct
from clickpath.operators.funnel import rate_by, share_of_total
from clickpath.plans.context import Funnel
from clickpath.plans.registry import analysis

FIRST3 = ["first_touch_traffic_channel", "first_touch_utm_campaign", "first_touch_utm_content"]
LAST3 = ["last_touch_traffic_channel", "last_touch_utm_campaign", "last_touch_utm_content"]
B = ("B",)


def _converted(f: Funnel, col: str = "last_touch_website_session_id") -> DataFrame:
    return f.attribution.filter(F.col(col).isNotNull())


@analysis("q06_1_introduced_all", "A", also=B, order=('-Users_Introduced',))
def introduced_all(f: Funnel) -> DataFrame:
    """First-touch channel × campaign × content: users introduced."""
    return f.attribution.groupBy(*FIRST3).agg(F.count("user_id").alias("Users_Introduced"))


@analysis("q06_2_introduced_converters", "A", also=B, order=('-Converting_Users_Introduced',))
def introduced_converters(f: Funnel) -> DataFrame:
    """Same, converters only (a converting touch exists)."""
    return (_converted(f, "last_touch_utm_campaign").groupBy(*FIRST3)
            .agg(F.count("user_id").alias("Converting_Users_Introduced")))


@analysis("q06_3_campaign_share", "A", also=B, order=('-Converting_Users',))
def campaign_share(f: Funnel) -> DataFrame:
    """First-touch campaign: converters and their share of all converters."""
    g = (_converted(f, "last_touch_utm_campaign").groupBy("first_touch_utm_campaign")
         .agg(F.count("user_id").alias("Converting_Users")))
    return share_of_total(g, "Converting_Users", "Pct_Of_Conversions")


@analysis("q06_4_closed", "A", also=B, order=('-Sales_Closed',))
def closed(f: Funnel) -> DataFrame:
    """Converting-touch channel × campaign × content: sales closed."""
    return _converted(f, "last_touch_traffic_channel").groupBy(*LAST3).agg(F.count("user_id").alias("Sales_Closed"))


@analysis("q06_5_closed_share", "A", also=B, order=('-Sales_Closed',))
def closed_share(f: Funnel) -> DataFrame:
    g = (_converted(f, "last_touch_traffic_channel").groupBy("last_touch_traffic_channel")
         .agg(F.count("user_id").alias("Sales_Closed")))
    return share_of_total(g, "Sales_Closed", "Pct_Of_Conversions")


@analysis("q06_5b_closed_content_share", "A", also=B, order=('-Sales_Closed',))
def closed_content_share(f: Funnel) -> DataFrame:
    g = (_converted(f, "last_touch_traffic_channel")
         .groupBy("last_touch_traffic_channel", "last_touch_utm_content")
         .agg(F.count("user_id").alias("Sales_Closed")))
    return share_of_total(g, "Sales_Closed", "Pct_Of_Conversions")


@analysis("q06_6_cross_channel", "A", also=B)
def cross_channel(f: Funnel) -> DataFrame:
    """Converters whose channel changed between first and converting touch, and their %."""
    a = f.attribution
    g = a.agg(
        F.count(F.when(F.col("first_touch_traffic_channel") != F.col("last_touch_traffic_channel"),
                       F.col("user_id"))).alias("Cross_Channel_Conversions"),
        F.count(F.when(F.col("last_touch_traffic_channel").isNotNull(), F.col("user_id"))).alias("conv"))
    return g.select("Cross_Channel_Conversions", pct("Cross_Channel_Conversions", "conv").alias("Pct_Of_Converters"))


@analysis("q06_7_single_session", "A", also=B)
def single_session(f: Funnel) -> DataFrame:
    """Converters whose first session is the converting session, and their %."""
    a = f.attribution
    g = a.agg(
        F.count(F.when(F.col("first_touch_website_session_id") == F.col("last_touch_website_session_id"),
                       F.col("user_id"))).alias("Single_Session_Converters"),
        F.count(F.when(F.col("last_touch_website_session_id").isNotNull(), F.col("user_id"))).alias("conv"))
    return g.select("Single_Session_Converters",
                    pct("Single_Session_Converters", "conv").alias("Pct_Of_Converters"))


@analysis("q06_8_paths", "A", also=B, order=('-Combination_Count',))
def paths(f: Funnel) -> DataFrame:
    """First triple × converting triple: users."""
    return (_converted(f, "last_touch_traffic_channel").groupBy(*FIRST3, *LAST3)
            .agg(F.count("user_id").alias("Combination_Count")))


@analysis("q06_8b_full_switch", "A", also=B, order=('-Combination_Count',))
def full_switch(f: Funnel) -> DataFrame:
    """Same, only where channel, campaign and content all differ."""
    cond = F.lit(True)
    for a, b in zip(FIRST3, LAST3):
        cond = cond & (F.col(a) != F.col(b))
    return (_converted(f, "last_touch_traffic_channel").filter(cond).groupBy(*FIRST3, *LAST3)
            .agg(F.count("user_id").alias("Combination_Count")))


def _converter_session_counts(f: Funnel) -> DataFrame:
    converters = _converted(f).select("user_id").distinct()
    return (f["sessions"].select("user_id", "website_session_id")
            .join(converters, "user_id", "left_semi")
            .groupBy("user_id").agg(F.count("website_session_id").alias("session_count")))


@analysis("q06_9_avg_sessions", "A", also=B)
def avg_sessions(f: Funnel) -> DataFrame:
    """Mean number of sessions (all of them, also after converting) per converter."""
    g = _converter_session_counts(f).agg(F.sum("session_count").alias("t"), F.count(F.lit(1)).alias("n"))
    return g.select(exact_mean("t", "n").alias("Avg_Sessions_To_Convert"))


@analysis("q06_9b_sessions_dist", "A", also=B, order=('session_count',))
def sessions_dist(f: Funnel) -> DataFrame:
    """Sessions per converter -> users, % of converters."""
    g = _converter_session_counts(f).groupBy("session_count").agg(F.count("user_id").alias("User_Count"))
    return share_of_total(g, "User_Count", "Pct")


def _journeys(f: Funnel) -> DataFrame:
    # The touch times travel with the attribution rows: no role joins back to sessions.
    return _converted(f).withColumn(
        "Days_To_Convert", day_diff("first_touch_created_at", "last_touch_created_at"))


@analysis("q06_10_days_to_convert", "B")
def days_to_convert(f: Funnel) -> DataFrame:
    """Mean, min and max calendar days from first touch to the converting session."""
    g = _journeys(f).agg(F.sum("Days_To_Convert").alias("t"), F.count("Days_To_Convert").alias("n"),
                         F.min("Days_To_Convert").alias("Min_Days"), F.max("Days_To_Convert").alias("Max_Days"))
    return g.select(exact_mean("t", "n").alias("Avg_Days_To_Convert"), "Min_Days", "Max_Days")


@analysis("q06_10b_journeys", "B", order=('-Days_To_Convert',))
def journeys(f: Funnel) -> DataFrame:
    """Per converter: first and converting campaign, both times and the days between (row grain)."""
    return _journeys(f).select(
        "user_id", "first_touch_utm_campaign", "last_touch_utm_campaign",
        F.col("first_touch_created_at").alias("First_Touch_Timestamp"),
        F.col("last_touch_created_at").alias("Last_Touch_Timestamp"), "Days_To_Convert")


@analysis("q06_11_channel_conv_rate", "A", also=B, order=('-First_Touch_Conv_Rate_Pct',))
def channel_conv_rate(f: Funnel) -> DataFrame:
    """First-touch channel: users, converters, conversion %."""
    return rate_by(f.attribution, ["first_touch_traffic_channel"],
                   F.col("last_touch_website_session_id").isNotNull(), "All_Users", "Converting_Users",
                   "First_Touch_Conv_Rate_Pct", total=F.col("first_touch_traffic_channel"))


@analysis("q06_12_lifetime_revenue", "A", also=B, order=('-Total_Revenue',))
def lifetime_revenue(f: Funnel) -> DataFrame:
    """First-touch channel: converters' total order revenue, mean per converter, converters.

    Orders are reduced to one revenue figure per user before the join.
    """
    per_user = f["orders"].groupBy("user_id").agg(F.sum("price_usd").alias("lifetime_revenue"))
    conv = _converted(f).select(F.col("first_touch_traffic_channel").alias("Channel"), "user_id")
    rows = conv.join(per_user, "user_id", "left")
    g = rows.groupBy("Channel").agg(
        F.sum("lifetime_revenue").cast(MONEY).alias("Total_Revenue"),
        F.count("lifetime_revenue").alias("n_rev"),
        F.count("user_id").alias("Converting_Users"))
    return g.select("Channel", "Total_Revenue",
                    money_per_unit("Total_Revenue", "n_rev").alias("Avg_Lifetime_Revenue_Per_User"),
                    "Converting_Users")
