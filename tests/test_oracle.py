"""Spark vs the independent DuckDB oracle on the driver tables.

The default run covers a representative key per analysis family at sf0.001;
CLICKPATH_FULL_ORACLE=1 runs every registered key at sf0.01 (what the driver checks).
"""

import os

import pytest

import __spark_entry__ as entry
from conftest import SF_ORACLE, SF_SMALL
from helpers import duck_rows, spark_rows

SAMPLE = [
    "q01_1_product_margin", "q01_3_refund_rate_c", "q02_1_new_vs_returning", "q02_5_cohort_retention",
    "q03_2_revenue_per_visit", "q04_2_landing_funnel", "q04_6_landing_product_conv", "q05_8_multivariate_rank",
    "q06_8b_full_switch_b", "q06_10_days_to_convert", "q06_12_lifetime_revenue", "q07_5_last_page",
    "q07_7_recency", "q08_1_pairs_c", "q08_3_take_rate", "dq_profile", "dq_duplicates_c",
    "dq_price_reconciliation_outer", "eda_order_describe_c", "eda_order_value_hist", "m_share_shift_b",
    "size_cross_sell_c", "size_device_gap", "dim_date_b", "m_monthly_growth",
]
FULL = os.environ.get("CLICKPATH_FULL_ORACLE") == "1"
KEYS = sorted(entry.oracle_sql()) if FULL else SAMPLE
SF = SF_ORACLE if FULL else SF_SMALL


@pytest.fixture(scope="module")
def con(duck):
    return duck(SF)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    df = entry.queries()[key](spark, SF)
    s_cols, s_rows = spark_rows(df)
    d_cols, d_rows = duck_rows(con, entry.oracle_sql()[key])
    assert s_cols == d_cols
    assert s_rows == d_rows


def test_every_report_has_an_oracle():
    """Reports all have SQL; of the training-data queries those that say so."""
    from clickpath.plans import REGISTRY
    training, sql = entry._llm()
    assert set(entry.queries()) == set(REGISTRY) | set(training)
    assert set(entry.oracle_sql()) == set(REGISTRY) | set(sql) and set(sql) <= set(training)
