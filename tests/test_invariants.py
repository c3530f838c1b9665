"""Invariants of the views and reports on the driver data (sf0.001)."""

from pyspark.sql import functions as F

from clickpath.plans import attribution, landing, nonconverters, traffic
from clickpath.plans.context import Funnel
from clickpath.sources.adapters import fixture_tables
from conftest import SF_SMALL


def _f(spark, fx="A"):
    return Funnel(fixture_tables(spark, SF_SMALL, fx))


def test_view_grains(spark):
    f = _f(spark)
    assert f.session_funnel.count() == f["sessions"].count()
    assert f.attribution.count() == f["sessions"].select("user_id").distinct().count()
    assert f.landing.count() == f["pageviews"].select("website_session_id").distinct().count()


def test_flags_are_binary(spark):
    f = _f(spark)
    cols = ["saw_product", "clicked_product", "saw_cart", "saw_shipping", "saw_billing", "saw_thank_you"]
    bad = f.landing.filter(" OR ".join(f"{c} NOT IN (0, 1)" for c in cols)).count()
    assert bad == 0


def test_converters_plus_non_converters_is_users(spark):
    for fx in ("A", "B"):
        r = nonconverters.non_converters(_f(spark, fx)).first()
        conv = _f(spark, fx).attribution.filter(F.col("last_touch_website_session_id").isNotNull()).count()
        assert r.Non_Converters + conv == r.Total_Users


def test_shares_sum_to_hundred(spark):
    for df, col in ((landing.landing_share(_f(spark)), "Traffic_Share_Pct"),
                    (traffic.traffic_share(_f(spark)), "Traffic_Share_Pct"),
                    (attribution.closed_share(_f(spark, "B")), "Pct_Of_Conversions")):
        total = df.agg(F.sum(col)).first()[0]
        assert abs(total - 100.0) < 0.01 * df.count() + 1e-9


def test_retained_never_exceeds_cohort(spark):
    from clickpath.plans.repeat import cohort_retention
    assert cohort_retention(_f(spark, "B")).filter("Retained_Users > Cohort_Size").count() == 0
