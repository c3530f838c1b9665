"""Loads with bad rows: nothing is lost, and a load that fails its audit changes nothing."""

import pytest

from clickpath.sources.quarantine import LoadRejected, judged_rows, load_all, load_table
from test_ingest import CSV, _write

HEAD = "order_id,created_at,website_session_id,user_id,primary_product_id,items_purchased,price_usd,cogs_usd\n"
GOOD = [f"{k},2012-03-19 10:42:46,{k},1,1,1,49.99,19.49" for k in range(1, 41)]
BAD = ["x1,2012-03-19 10:42:46,1,1,1,1,49.99,19.49", "41,2012-13-45 10:42:46,1,1,1,1,49.99,19.49", "42,19/03/2012,1,1,1,1,abc,19.49",
       "43,2012-03-19 10:42:46,1,1", "44,2012-03-19 10:42:46,1,1,1,1,49.99,19.49,extra", "99999999999999999999,2012-03-19 10:42:46,1,1,1,1,1,1"]
NULLS = ["45,NA,,NULL,1,1,,nan"]


def _orders(folder, lines, name="orders.csv"):
    with open(f"{folder}/{name}", "w") as f:
        f.write(HEAD + "\n".join(lines) + "\n")
    return f"{folder}/{name}"


def test_good_and_bad_rows_are_all_rows(spark, scratch):
    path = _orders(scratch, GOOD + BAD + NULLS)
    load = load_table(spark, path, "orders", f"{scratch}/out", max_rejected=0.2)
    good, bad = spark.read.parquet(load.path), spark.read.parquet(load.quarantine)
    assert (load.rows, load.rejected) == (len(GOOD + BAD + NULLS), len(BAD))
    assert good.count() + bad.count() == load.rows and good.count() == len(GOOD + NULLS)
    assert load.nulls == {"order_id": 0, "created_at": 1, "website_session_id": 1, "user_id": 1, "primary_product_id": 0, "items_purchased": 0, "price_usd": 1, "cogs_usd": 1}
    assert dict(good.dtypes)["created_at"] == "timestamp_ntz" and dict(good.dtypes)["price_usd"] == "decimal(18,2)"
    reasons = {r["row"].split(",")[0]: r["reasons"] for r in bad.collect()}
    assert reasons["x1"] == ["order_id: no bigint: x1"] and reasons["42"] == ["created_at: no timestamp: 19/03/2012", "price_usd: no decimal(18,2): abc"]
    assert reasons["43"] == reasons["44"] == ["the number of fields differs from the header"]
    assert all(r["file"].endswith("/orders.csv") and r["table_name"] == "orders" for r in bad.collect())


def test_budget_and_checks_leave_the_old_table(spark, scratch):
    out = f"{scratch}/out"
    load_table(spark, _orders(scratch, GOOD), "orders", out)
    with pytest.raises(LoadRejected, match="6 of 46 rows rejected") as failed:
        load_table(spark, _orders(scratch, GOOD + BAD), "orders", out)
    assert spark.read.parquet(failed.value.staged).count() == 46
    with pytest.raises(LoadRejected, match="'few'"):
        load_table(spark, _orders(scratch, GOOD[:3]), "orders", out, checks={"few": lambda df: df.count() > 10})
    assert spark.read.parquet(f"{out}/orders").count() == 40 and spark.read.parquet(f"{out}/orders_rejected").count() == 0
    load_table(spark, _orders(scratch, GOOD[:3]), "orders", out)
    assert spark.read.parquet(f"{out}/orders").count() == 3


def test_swapped_header_is_an_error(spark, scratch):
    with open(f"{scratch}/x.csv", "w") as f:
        f.write("product_name,created_at,product_id\nBear,2024-01-01 00:00:00,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        judged_rows(spark, f"{scratch}/x.csv", "products").collect()


def test_whole_folder(spark, scratch):
    _write(scratch)
    loads = load_all(spark, scratch, f"{scratch}/out")
    assert {t: (x.rows, x.rejected) for t, x in loads.items()} == {
        "sessions": (3, 0), "pageviews": (2, 0), "orders": (1, 0), "order_items": (1, 0), "order_item_refunds": (0, 0), "products": (1, 0)}
    assert len(loads) == len(CSV)
