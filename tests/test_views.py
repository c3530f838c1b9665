"""Hand-written cases for the session and user tables (fixtures §3, cases 1-12)."""

from clickpath.operators.cleaning import page_name_col
from clickpath.plans.context import Funnel
from helpers import tables, ts

T0 = "2024-01-05 10:00:00"


def _s(sid, user, t=T0, rep=0, src=None, camp=None, cont=None, dev="desktop", ref=None):
    return (sid, ts(t), user, rep, src, camp, cont, dev, ref)


def test_landing_tie_broken_by_pageview_id(spark):
    f = Funnel(tables(spark, sessions=[_s(10, 1)],
                      pageviews=[(2, ts(T0), 10, "/home"), (1, ts(T0), 10, "/lander-1")]))
    assert f.landing.first().Landing_Page == "Lander-1"


def test_product_label_is_greatest(spark):
    f = Funnel(tables(spark, sessions=[_s(10, 1)],
                      pageviews=[(1, ts(T0), 10, "/the-original-mr-fuzzy"),
                                 (2, ts("2024-01-05 10:01:00"), 10, "/the-forever-love-bear")]))
    rows = f.product_view.collect()
    assert [r.Page_Name for r in rows] == ["The Original Mr Fuzzy"]


def test_home_only_session(spark):
    f = Funnel(tables(spark, sessions=[_s(10, 1)], pageviews=[(1, ts(T0), 10, "/home")]))
    assert f.product_view.count() == 0
    r = f.landing.first()
    assert (r.saw_product, r.saw_cart, r.saw_thank_you) == (0, 0, 0)


def test_session_without_pageviews_keeps_null_flags(spark):
    f = Funnel(tables(spark, sessions=[_s(10, 1), _s(11, 2)], pageviews=[(1, ts(T0), 10, "/home")]))
    sf = {r.website_session_id: r for r in f.session_funnel.collect()}
    assert sf[11].saw_product is None and sf[11].session_revenue is None
    assert len(sf) == 2


def test_unknown_landing_is_null_and_billing_2_counts(spark):
    f = Funnel(tables(spark, sessions=[_s(10, 1)],
                      pageviews=[(1, ts(T0), 10, "/unknown"), (2, ts("2024-01-05 10:02:00"), 10, "/billing-2")]))
    r = f.landing.first()
    assert r.Landing_Page is None and r.saw_billing == 1


def test_session_revenue_sums_items(spark):
    f = Funnel(tables(spark, sessions=[_s(10, 1)], pageviews=[(1, ts(T0), 10, "/home")],
                      orders=[(100, ts(T0), 10, 1, 1, 2, 79.98, 30.0)],
                      items=[(1, ts(T0), 100, 1, 1, 49.99, 20.0), (2, ts(T0), 100, 4, 0, 29.99, 10.0)]))
    assert str(f.session_funnel.first().session_revenue) == "79.98"


def test_converting_touch_first_and_last_order(spark):
    t = tables(spark, sessions=[_s(5, 1, "2024-01-10 00:00:00"), _s(9, 1, "2024-03-10 00:00:00"),
                                _s(1, 1, "2024-01-01 00:00:00")],
               orders=[(50, ts("2024-01-10 00:00:00"), 5, 1, 1, 1, 10.0, 4.0),
                       (90, ts("2024-03-10 00:00:00"), 9, 1, 1, 1, 10.0, 4.0)])
    assert Funnel(t).attribution.first().last_touch_website_session_id == 5
    assert Funnel(t, touch="last_order").attribution.first().last_touch_website_session_id == 9
    assert Funnel(t).attribution.first().first_touch_website_session_id == 1


def test_non_converter_one_row_null_last_touch(spark):
    f = Funnel(tables(spark, sessions=[_s(1, 7), _s(2, 7, "2024-01-06 00:00:00")]))
    rows = f.attribution.collect()
    assert len(rows) == 1 and rows[0].last_touch_website_session_id is None


def test_first_touch_tie_broken_by_session_id(spark):
    f = Funnel(tables(spark, sessions=[_s(8, 3), _s(7, 3)]))
    assert f.attribution.first().first_touch_website_session_id == 7


def test_channel_derived_before_fill(spark):
    t = tables(spark, sessions=[_s(1, 1, ref="https://x"), _s(2, 2), _s(3, 3, src="s_a", camp="brand", cont="ad_1")])
    got = {r.website_session_id: (r.traffic_channel, r.utm_source, r.http_referer) for r in t["sessions"].collect()}
    assert got == {1: ("organic", "none", "https://x"), 2: ("direct", "none", "none"), 3: ("s_a", "s_a", "none")}


def test_page_name_rule(spark):
    df = spark.createDataFrame([("/",), ("/home",), ("/cart/",), ("/a/b",)], "pageview_url string")
    assert [r[0] for r in df.select(page_name_col()).collect()] == ["home", "home", "cart", "a"]
