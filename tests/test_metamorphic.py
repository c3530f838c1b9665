"""Metamorphic checks: input partitioning and duplicated pageviews do not change results."""

from clickpath.plans.context import Funnel
from clickpath.sources.adapters import fixture_tables
from conftest import SF_SMALL
from helpers import spark_rows


def _views(f):
    return [f.product_view, f.landing, f.session_funnel,
            f.attribution.drop("first_touch_created_at", "last_touch_created_at")]


def test_repartitioned_input_same_views(spark):
    t = fixture_tables(spark, SF_SMALL, "A")
    t2 = dict(t)
    for k in ("sessions", "pageviews", "orders", "order_items"):
        t2[k] = t[k].repartition(7)
    for a, b in zip(_views(Funnel(t)), _views(Funnel(t2))):
        assert spark_rows(a) == spark_rows(b)


def test_duplicate_pageview_leaves_views_unchanged(spark):
    t = fixture_tables(spark, SF_SMALL, "A")
    t2 = dict(t)
    t2["pageviews"] = t["pageviews"].unionByName(t["pageviews"].limit(50))
    for a, b in zip(_views(Funnel(t)), _views(Funnel(t2))):
        assert spark_rows(a) == spark_rows(b)


def test_materialized_views_give_same_reports(spark, scratch):
    from clickpath.plans import landing, nonconverters
    f = Funnel(fixture_tables(spark, SF_SMALL, "A"))
    m = f.materialize(scratch + "/views")
    for fn in (landing.landing_funnel, landing.before_after, nonconverters.checkout_drop):
        assert spark_rows(fn(f)) == spark_rows(fn(m))


def test_bucketed_views_join_without_shuffle(spark):
    from clickpath.plans import landing
    f = Funnel(fixture_tables(spark, SF_SMALL, "A"))
    b = f.materialize_tables(prefix="t_bucketed", buckets=4)
    joined = b.flags.join(b.session_funnel.select("website_session_id", "session_revenue"), "website_session_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert spark_rows(landing.landing_funnel(f)) == spark_rows(landing.landing_funnel(b))
