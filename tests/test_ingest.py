"""CSV ingest with NULL markers, cleaning, sinks and the load-count check."""

import os

import pytest

from clickpath.sources.ingest import clean_tables, export_csv, load_counts, load_csv_tables, save_as_tables, write_counted, write_tables

CSV = {
    "website_sessions.csv": "website_session_id,created_at,user_id,is_repeat_session,utm_source,utm_campaign,"
                            "utm_content,device_type,http_referer\n"
                            "1,2012-03-19 08:04:16,1,0,gsearch,nonbrand,g_ad_1,mobile,https://www.gsearch.com\n"
                            "2,2012-03-19 08:16:49,2,0,,NA,,desktop,https://www.gsearch.com\n"
                            "3,2012-03-19 08:26:55,3,0,NULL,,,desktop,\n",
    "website_pageviews.csv": "website_pageview_id,created_at,website_session_id,pageview_url\n"
                             "1,2012-03-19 08:04:16,1,/lander-1\n2,2012-03-19 08:05:00,1,/products\n",
    "orders.csv": "order_id,created_at,website_session_id,user_id,primary_product_id,items_purchased,price_usd,"
                  "cogs_usd\n1,2012-03-19 10:42:46,1,1,1,1,49.99,19.49\n",
    "order_items.csv": "order_item_id,created_at,order_id,product_id,is_primary_item,price_usd,cogs_usd\n"
                       "1,2012-03-19 10:42:46,1,1,1,49.99,19.49\n",
    "order_item_refunds.csv": "order_item_refund_id,created_at,order_item_id,order_id,refund_amount_usd\n",
    "products.csv": "product_id,created_at,product_name\n1,2012-03-19 08:00:00,The Original Mr. Fuzzy\n",
}


def _write(d):
    for name, text in CSV.items():
        with open(os.path.join(d, name), "w") as fh:
            fh.write(text)


def test_csv_ingest_and_cleaning(spark, scratch):
    _write(scratch)
    raw = load_csv_tables(spark, scratch)
    s = {r.website_session_id: r for r in raw["sessions"].collect()}
    assert s[2].utm_source is None and s[2].utm_campaign is None and s[3].http_referer is None
    clean = clean_tables(raw)
    c = {r.website_session_id: (r.traffic_channel, r.utm_source) for r in clean["sessions"].collect()}
    assert c == {1: ("gsearch", "gsearch"), 2: ("organic", "none"), 3: ("direct", "none")}
    assert str(clean["orders"].first().gross_profit) == "30.50"
    assert [r.page_name for r in clean["pageviews"].orderBy("website_pageview_id").collect()] == ["lander-1", "products"]


def test_sinks_and_load_counts(spark, scratch):
    _write(scratch)
    clean = clean_tables(load_csv_tables(spark, scratch))
    out = os.path.join(scratch, "out")
    write_tables(clean, out)
    res = {r.table_name: (r.expected, r.actual, r.status) for r in load_counts(spark, clean, out).collect()}
    assert res["sessions"] == (3, 3, "OK") and res["order_item_refunds"] == (0, 0, "OK")
    export_csv(clean, os.path.join(scratch, "csv"))
    back = spark.read.option("header", True).csv(os.path.join(scratch, "csv", "sessions_clean"))
    assert back.count() == 3 and "traffic_channel" in back.columns


def test_case_folding_option(spark, scratch):
    _write(scratch)
    with open(os.path.join(scratch, "website_pageviews.csv"), "a") as fh:
        fh.write("3,2012-03-19 08:06:00,1,/Cart \n")
    clean = clean_tables(load_csv_tables(spark, scratch), case_insensitive=True)
    urls = {r.pageview_url for r in clean["pageviews"].collect()}
    assert "/cart" in urls


def test_catalog_tables_with_types_and_append(spark, scratch):
    _write(scratch)
    raw = load_csv_tables(spark, scratch)
    orders = {"orders": raw["orders"]}
    spark.sql("CREATE DATABASE IF NOT EXISTS loads")
    try:
        types = {"orders": {"price_usd": "decimal(10,2)", "order_id": "int"}}
        assert save_as_tables(orders, "loads", types=types) == ["loads.orders"]
        saved = spark.table("loads.orders")
        assert dict(saved.dtypes)["price_usd"] == "decimal(10,2)" and dict(saved.dtypes)["order_id"] == "int" and saved.count() == 1
        save_as_tables(orders, "loads", mode="append", types=types)
        assert spark.table("loads.orders").count() == 2
        save_as_tables(orders, "loads")
        assert spark.table("loads.orders").count() == 1 and dict(spark.table("loads.orders").dtypes)["order_id"] == "bigint"
        with pytest.raises(ValueError, match="no columns"):
            save_as_tables(orders, "loads", types={"orders": {"nope": "int"}})
    finally:
        spark.sql("DROP DATABASE loads CASCADE")


def test_written_rows_are_observed(spark, scratch):
    tables = {"a": spark.range(1000).repartition(7), "b": spark.range(0)}
    counts = write_counted(tables, scratch)
    assert counts == {"a": 1000, "b": 0}
    rows = load_counts(spark, tables, scratch, expected={"a": 1000, "b": 1}).collect()
    assert {r["table_name"]: (r["expected"], r["actual"], r["status"]) for r in rows} == {"a": (1000, 1000, "OK"), "b": (1, 0, "MISMATCH")}


def test_load_check_leaves_no_folder(spark):
    import __spark_entry__ as entry
    from clickpath.session import ensure_checkpoint_dir
    before = set(os.listdir(ensure_checkpoint_dir(spark)))
    rows = entry.queries()["dq_load_counts"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 6 and all(r["status"] == "OK" and r["expected"] > 0 for r in rows)
    assert {x for x in set(os.listdir(ensure_checkpoint_dir(spark))) - before if x.startswith("clickpath-load")} == set()


def test_key_overview_scans_once(spark, scratch):
    from clickpath.operators.quality import key_overview
    rows = [(k, None if k % 4 == 0 else -(k % 10) * 10 ** 15, "x") for k in range(100)] * 2 + [(None, 3, "y")]
    spark.createDataFrame(rows, "id long, fk long, v string").write.parquet(f"{scratch}/t")
    df = spark.read.parquet(f"{scratch}/t")
    out = key_overview(df, "t", "id", "fk")
    assert tuple(out.first()) == ("t", 201, 3, 100, len({r[1] for r in rows if r[1] is not None}))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange ") == 2
    assert tuple(key_overview(df, "t", "id", None).first()) == ("t", 201, 3, 100, None)
