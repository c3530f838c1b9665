"""Rules of the clickstream fixture and of CSV ingest that no report may bend."""

import datetime as dt

import pytest

from clickpath.sources.adapters import clickstream
from clickpath.sources.ingest import normalise_nulls, read_csv_table


def _events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def test_session_ids_never_collide(spark):
    """One session per (user, day), also before 2024 and after 999 days."""
    days = [dt.datetime(1999, 5, 4), dt.datetime(2023, 12, 31), dt.datetime(2024, 1, 1), dt.datetime(2026, 9, 27), dt.datetime(2040, 2, 29)]
    rows = [(10 * u + k, d, u, "view", 1.0, '{"k": 1}') for u in (1, 2, 3) for k, d in enumerate(days)]
    sessions = clickstream(_events(spark, rows))["sessions"].collect()
    assert len({r["website_session_id"] for r in sessions}) == len(sessions) == 15
    assert {(r["user_id"], r["created_at"]) for r in sessions} == {(u, d) for _, d, u, *_ in rows}


def test_all_purchases_of_an_ordering_session_are_items(spark):
    day = dt.datetime(2024, 3, 1)
    rows = [(k, day + dt.timedelta(hours=k), 1, "purchase", v, '{"k": %d}' % k) for k, v in enumerate((20.0, 200.0, 40.0, 200.0))]
    t = clickstream(_events(spark, rows))
    items = {r["order_item_id"]: r["is_primary_item"] for r in t["order_items"].collect()}
    assert items == {0: 0, 1: 1, 2: 0, 3: 0}
    order = t["orders"].first()
    assert (order["items_purchased"], float(order["price_usd"]), order["created_at"]) == (4, 460.0, day + dt.timedelta(hours=1))


def test_props_that_are_no_integer_are_null(spark):
    rows = [(k, dt.datetime(2024, 3, 1), k, "view", 1.0, p) for k, p in enumerate(('{"k": 7}', '{"k": 99999999999}', "{", None))]
    sources = {r["user_id"]: r["utm_source"] for r in clickstream(_events(spark, rows))["raw_sessions"].collect()}
    assert sources == {0: "s_a", 1: None, 2: None, 3: None}


def test_csv_columns_in_another_order_are_an_error(spark, scratch):
    with open(f"{scratch}/x.csv", "w") as f:
        f.write("product_name,created_at,product_id\nBear,2024-01-01 00:00:00,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv_table(spark, f"{scratch}/x.csv", "products").collect()


def test_null_markers_match_untrimmed(spark):
    df = spark.createDataFrame([("NA",), (" NA ",), ("x",)], "a string")
    assert [r["a"] for r in normalise_nulls(df).collect()] == [None, " NA ", "x"]
