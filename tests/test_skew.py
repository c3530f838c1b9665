"""Hot keys: one user owns a third of all events (and so a few huge sessions).

Results must still equal the oracle; the plans avoid windows and non-splittable
join sides over the hot key, so this also runs the skewed shapes end to end.
"""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from clickpath.sources.tables import DRIVER_TABLES
from conftest import SF_SMALL
from helpers import duck_rows, spark_rows

KEYS = ["q04_2_landing_funnel", "q05_8_multivariate_rank", "q06_1_introduced_all", "q06_9b_sessions_dist",
        "q07_5_last_page_a", "q07_6_checkout_drop", "q07_4_avg_sessions", "q02_1_new_vs_returning",
        "q08_1_pairs", "dq_duplicates", "m_never_cart_pct"]


@pytest.fixture(scope="module")
def skewed_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("skewed"))
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    hot = ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(7)).otherwise(F.col("user_id")))
    hot.write.parquet(f"{d}/events.parquet")
    for t in DRIVER_TABLES:
        if t != "events":
            os.symlink(f"{SF_SMALL}/{t}.parquet", f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("key", KEYS)
def test_hot_user_matches_oracle(spark, duck, skewed_dir, key):
    con = duck(skewed_dir)
    s_cols, s_rows = spark_rows(entry.queries()[key](spark, skewed_dir))
    d_cols, d_rows = duck_rows(con, entry.oracle_sql()[key])
    assert s_cols == d_cols and s_rows == d_rows
