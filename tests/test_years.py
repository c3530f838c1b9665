"""Reports over several years, and checks that find their violations: rows that a wrong plan could not give."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    return lambda key: entry.queries()[key](spark, SF).collect()


def test_two_periods(rows):
    got = rows("q04_9b_before_after_d")
    assert len(got) == 2 and all(r["Sessions"] > 100 and r["Total_Revenue"] > 0 for r in got)


def test_active_months(rows):
    assert all(r["Months_Active"] > 6 for key in ("q04_1b_landing_active_period_d", "q05_2_campaign_period_d") for r in rows(key))
    r, = rows("size_foregone_revenue_d")
    assert r["Months_Active"] > 6 and r["Monthly_Revenue"] > 0 and r["Foregone_Revenue"] is not None
    growth = rows("m_monthly_growth_d")
    assert len(growth) > 12 and len({r["revenue_pct_of_first_month"] for r in growth}) > 12


def test_violations_are_found(rows):
    assert [(r["page_name"], r["views"] > 0) for r in rows("dq_page_domain_d")] == [("odd-page", True)]
    off = rows("dq_price_reconciliation_d")
    assert off and all(abs(float(r["difference"]) - 0.01) < 1e-9 and r["order_id"] % 5 == 0 for r in off)
    r, = rows("dq_product_domain_c")
    assert not r["same_set"] and r["unexpected_ids"] > 0 and r["missing_ids"] == 4
