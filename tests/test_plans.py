"""Plan shape: no Cartesian products, no Python evaluation, filters reach the scan."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(entry.queries()))
def test_no_cartesian_no_python(spark, key):
    plan = _plan(entry.queries()[key](spark, SF_SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, f"{key}: {bad}"


def test_filter_and_pruning_reach_parquet(spark):
    plan = _plan(entry.queries()["q06_4_closed_b"](spark, SF_SMALL))
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan
    # only the used columns are read: the totals and the line items are never scanned here
    assert "o_totalprice" not in plan and "lineitem" not in plan


def test_items_are_picked_without_a_window(spark):
    """The largest purchase of a session is a map-side minimum joined back, not a window."""
    from clickpath.sources.adapters import fixture_tables
    plan = _plan(fixture_tables(spark, SF_SMALL, "A")["order_items"])
    assert "Window" not in plan and "partial_min" in plan


@pytest.mark.parametrize("key", ["q04_2_landing_funnel", "q03_1_product_funnel", "q05_8_multivariate_rank", "q06_1_introduced_all", "q06_1_introduced_all_b", "q06_4_closed_b", "q07_4_avg_sessions_b"])
def test_views_are_hash_aggregated(spark, key):
    """First and last picks have buffers of fixed width: no sort of all events or sessions."""
    plan = _plan(entry.queries()[key](spark, SF_SMALL))
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_session_and_user_picks_combine_map_side(spark):
    """First/last picks are aggregates with a partial (map-side) phase below the shuffle."""
    from clickpath.plans.context import Funnel
    from clickpath.sources.adapters import fixture_tables
    f = Funnel(fixture_tables(spark, SF_SMALL, "A"))
    for df in (f.flags, f.attribution):
        plan = _plan(df)
        assert "partial_min" in plan, plan[:500]
        assert "Window" not in plan.split("Exchange")[0] or "WindowGroupLimit" in plan


def test_basket_refund_filter_reaches_scan(spark):
    assert "EqualTo(l_returnflag,R)" in _plan(entry.queries()["q01_3_refund_rate_c"](spark, SF_SMALL))
