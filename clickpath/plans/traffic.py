"""Device and traffic-source reports over sessions and the session funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpath.operators.funnel import active_period, funnel_rates, revenue_per, share_of_total
from clickpath.plans.context import Funnel
from clickpath.plans.registry import analysis

_MIX = ("traffic_channel", "utm_campaign", "device_type")


@analysis("q05_1_traffic_share", "A", order=('traffic_channel', 'utm_campaign', 'device_type'))
def traffic_share(f: Funnel) -> DataFrame:
    """Channel × campaign × device: sessions and share of all sessions."""
    g = f["sessions"].groupBy(*_MIX).agg(F.count("website_session_id").alias("Sessions"))
    return share_of_total(g, "Sessions", "Traffic_Share_Pct")


@analysis("q05_2_campaign_period", "A", also=("D",), order=('-Months_Active',))
def campaign_period(f: Funnel) -> DataFrame:
    """Per campaign: first and last year seen, months between first and last session."""
    return active_period(f["sessions"], "utm_campaign").select(
        "utm_campaign", F.col("first_year").alias("Launch_Year"), F.col("last_year").alias("Last_Active_Year"),
        F.col("months").alias("Months_Active"))


@analysis("q05_3_new_vs_repeat", "A", order=('traffic_channel', 'utm_campaign', 'device_type'))
def new_vs_repeat(f: Funnel) -> DataFrame:
    """Channel × campaign × device: new and returning sessions."""
    return f["sessions"].groupBy(*_MIX).agg(
        F.count(F.when(F.col("is_repeat_session") == 0, 1)).alias("New_Sessions"),
        F.count(F.when(F.col("is_repeat_session") == 1, 1)).alias("Returning_Sessions"))


def _rates_by(key: str, fixture_key: str):
    @analysis(fixture_key, "A")
    def run(f: Funnel) -> DataFrame:
        return funnel_rates(f.session_funnel, [key], overall=True)
    run.__name__ = f"funnel_by_{key}"
    run.__doc__ = f"Per {key}: five step rates and overall conversion over all sessions."
    return run


device_funnel = _rates_by("device_type", "q05_4_device_funnel")
channel_funnel = _rates_by("traffic_channel", "q05_5_channel_funnel")
campaign_funnel = _rates_by("utm_campaign", "q05_6_campaign_funnel")
content_funnel = _rates_by("utm_content", "q05_7_content_funnel")


@analysis("q05_8_multivariate_rank", "A", order=('-Overall_Conv_Rate_Pct',))
def multivariate_rank(f: Funnel) -> DataFrame:
    """Device × channel × campaign × content: the step rates, best overall conversion first."""
    keys = ["device_type", "traffic_channel", "utm_campaign", "utm_content"]
    return funnel_rates(f.session_funnel, keys, overall=True)


def _revenue_by(key: str, fixture_key: str):
    @analysis(fixture_key, "A")
    def run(f: Funnel) -> DataFrame:
        return revenue_per(f.session_funnel, [key])
    run.__name__ = f"revenue_by_{key}"
    run.__doc__ = f"Per {key}: sessions, revenue, revenue per session."
    return run


channel_revenue = _revenue_by("traffic_channel", "q05_9_channel_revenue")
device_revenue = _revenue_by("device_type", "q05_10_device_revenue")
campaign_revenue = _revenue_by("utm_campaign", "q05_11_campaign_revenue")
content_revenue = _revenue_by("utm_content", "q05_12_content_revenue")
