"""Hand-written cases for the reports (fixtures §3, cases 13-25)."""

from clickpath.plans import crosssell, nonconverters, quality, repeat, revenue
from clickpath.plans.context import Funnel
from helpers import tables, ts

T0 = "2024-01-05 10:00:00"


def _s(sid, user, t=T0, rep=0):
    return (sid, ts(t), user, rep, None, None, None, "desktop", None)


def test_fan_out_counts_as_coded(spark):
    f = Funnel(tables(spark, sessions=[_s(1, 1)],
                      orders=[(10, ts(T0), 1, 1, 1, 2, 79.98, 30.0)],
                      items=[(1, ts(T0), 10, 1, 1, 49.99, 20.0), (2, ts(T0), 10, 4, 0, 29.99, 10.0)]))
    r = repeat.new_vs_returning(f).first()
    assert r.Volume == 4 and r.Revenue_Per_Session == 39.99


def test_purchases_per_month_is_integer(spark):
    sessions = [_s(i, i, rep=1) for i in range(1, 8)]
    orders = [(100 + i, ts(T0), i, i, 1, 1, 10.0, 4.0) for i in range(1, 8)]
    items = [(200 + i, ts("2023-05-10 00:00:00") if i == 1 else ts(T0), 100 + i, 1, 1, 10.0, 4.0)
             for i in range(1, 8)]
    products = [(1, ts("2023-11-01 00:00:00"), "P")]
    r = repeat.repeat_product_rate(Funnel(tables(spark, sessions, [], orders, items, [], products))).first()
    assert (r.Purchase_Count, r.Months_In_Market, r.Repeat_Purchases_Per_Month) == (7, 2, 3)


def test_recency_buckets_and_truncated_mean(spark):
    days = [0, 30, 31, 90, 91, 180, 181, 365, 366]
    end = "2024-12-31 00:00:00"
    import datetime as dt
    e = dt.datetime.fromisoformat(end)
    sessions = [_s(i + 1, i + 1, (e - dt.timedelta(days=d)).isoformat(sep=" ")) for i, d in enumerate(days)]
    pageviews = [(i + 1, ts((e - dt.timedelta(days=d)).isoformat(sep=" ")), i + 1, "/home") for i, d in enumerate(days)]
    got = {r.Recency_Bucket: (r.User_Count, r.Avg_Days_Since_Visit)
           for r in nonconverters.recency(Funnel(tables(spark, sessions, pageviews))).collect()}
    assert got["Recently Lapsed (0-30 days)"] == (2, 15)
    assert got["Moderately Lapsed (31-90 days)"] == (2, 60)
    assert got["Very Cold (181-365 days)"] == (2, 273)
    assert got["Likely Gone (365+ days)"] == (1, 366)


def test_product_never_sold_and_never_refunded(spark):
    items = [(1, ts(T0), 10, 1, 1, 49.99, 20.0)]
    got = {r.Product: r for r in revenue.refund_rate(Funnel(tables(spark, items=items))).collect()}
    assert got["The Forever Love Bear"].Total_Items_Sold == 0
    assert got["The Forever Love Bear"].Refund_Rate_Pct is None
    assert got["The Original Mr. Fuzzy"].Refund_Rate_Pct == 0.0
    assert got["The Original Mr. Fuzzy"].Revenue_Lost is None


def test_checkout_drop_counts_sessions(spark):
    sessions = [_s(1, 1), _s(2, 1, "2024-01-06 00:00:00")]
    pageviews = [(1, ts(T0), 1, "/cart"), (2, ts("2024-01-06 00:00:00"), 2, "/cart")]
    r = nonconverters.checkout_drop(Funnel(tables(spark, sessions, pageviews))).first()
    assert (r.Total_Non_Converters, r.Reached_Cart, r.Dropped_At_Cart) == (1, 2, 2)


def test_last_page_keeps_ties(spark):
    sessions = [_s(1, 1)]
    pageviews = [(1, ts(T0), 1, "/cart"), (2, ts(T0), 1, "/shipping")]
    got = {r.page_name: r.User_Count for r in nonconverters.last_page(Funnel(tables(spark, sessions, pageviews))).collect()}
    assert got == {"cart": 1, "shipping": 1}


def test_cohort_offsets(spark):
    orders = [(1, ts("2024-01-03 00:00:00"), 1, 9, 1, 1, 10.0, 4.0),
              (2, ts("2024-01-20 00:00:00"), 2, 9, 1, 1, 10.0, 4.0),
              (3, ts("2024-03-02 00:00:00"), 3, 9, 1, 1, 10.0, 4.0)]
    rows = repeat.cohort_retention(Funnel(tables(spark, orders=orders))).collect()
    assert [(r.Months_Since_First_Purchase, r.Retained_Users, r.Cohort_Size, r.Retention_Pct) for r in rows] == \
        [(2, 1, 1, 100.0)]


def test_order_type_else_branch(spark):
    orders = [(i, ts(T0), i, i, 1, n, 10.0, 4.0) for i, n in enumerate([0, 1, 2, 3], start=1)]
    got = {r.Order_Type: r.Order_Count for r in crosssell.order_type(Funnel(tables(spark, orders=orders))).collect()}
    assert got == {"Single Item": 1, "Two Items": 3}


def test_seeded_violations_are_reported(spark):
    sessions = [_s(1, 1)]
    orders = [(10, ts(T0), 1, 1, 1, 1, 10.0, 4.0), (10, ts(T0), 99, 1, 1, 1, 0.0, 4.0),
              (11, ts(T0), 1, 1, 1, 1, None, 4.0)]
    items = [(1, ts(T0), 10, 1, 1, 10.0, 4.0)]
    refunds = [(1, ts(T0), 1, 10, 50.0)]
    f = Funnel(tables(spark, sessions, [], orders, items, refunds))
    dup = {r.table_name: r.duplicate_keys for r in quality.duplicates(f).collect()}
    assert dup["orders"] == 1
    ri = {r.check: r.violations for r in quality.referential_integrity(f).collect()}
    assert ri["orders_to_sessions"] == 1
    pos = {(r.check, r.table_name): r.violations for r in quality.positive_amounts(f).collect()}
    assert pos[("price_usd_positive", "orders")] == 2
    assert quality.refund_cap(f).first().violations == 1
    recon = quality.price_reconciliation_outer(f).collect()
    assert {r.order_id for r in recon} >= {11}


def test_full_switch_needs_all_three_to_differ(spark):
    from clickpath.plans import attribution
    # user 1: first touch direct/none/none, converts on s_a/brand/none: content 'none' = 'none' -> not a full switch
    sessions = [(1, ts("2024-01-01 00:00:00"), 1, 0, None, None, None, "desktop", None),
                (2, ts("2024-01-02 00:00:00"), 1, 1, "s_a", "brand", None, "desktop", None)]
    orders = [(10, ts("2024-01-02 00:00:00"), 2, 1, 1, 1, 10.0, 4.0)]
    f = Funnel(tables(spark, sessions, orders=orders))
    assert attribution.full_switch(f).count() == 0
    assert attribution.paths(f).count() == 1
