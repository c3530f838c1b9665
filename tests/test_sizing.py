"""Opportunity sizing against hand-computed values (the published arithmetic, at small scale)."""

from decimal import Decimal

from clickpath.plans import derived
from clickpath.plans.context import Funnel
from helpers import tables, ts

T0 = "2024-01-05 10:00:00"


def _s(sid, user, dev="desktop", t=T0):
    return (sid, ts(t), user, 0, None, None, None, dev, None)


def test_cross_sell_sizing_hand_computed(spark):
    # 10 primary orders of product 1; 2 of them also hold product 4 (29.99): rate 20 %.
    # Target 30 % -> 10 pp -> 1.00 extra order -> 29.99.
    orders, items = [], []
    for i in range(10):
        two = i < 2
        orders.append((i, ts(T0), i, i, 1, 2 if two else 1, 79.98 if two else 49.99, 20.0))
        items.append((100 + i, ts(T0), i, 1, 1, 49.99, 19.49))
        if two:
            items.append((200 + i, ts(T0), i, 4, 0, 29.99, 9.49))
    r = derived.cross_sell_sizing(Funnel(tables(spark, orders=orders, items=items))).first()
    assert (r.Primary_Orders, r.Current_Rate_Pct, r.CrossSell_Product_ID) == (10, 20.0, 4)
    assert r.Extra_CrossSell_Orders == Decimal("1.00") and r.Estimated_Revenue == Decimal("29.99")


def test_step_uplift_hand_computed(spark):
    # 4 sessions on one product page, 2 reach cart, 1 buys: completion 50 %; AOV = 60.00.
    # 4 x 5 % x 50 % x 60.00 x 0.5 = 3.00
    sessions = [_s(i, i) for i in range(4)]
    pv = [(10 * i + 1, ts(T0), i, "/the-original-mr-fuzzy") for i in range(4)]
    pv += [(10 * i + 2, ts("2024-01-05 10:01:00"), i, "/cart") for i in range(2)]
    pv += [(3, ts("2024-01-05 10:02:00"), 0, "/thank-you-for-your-order")]
    orders = [(1, ts(T0), 0, 0, 1, 1, 60.0, 20.0)]
    r = derived.step_uplift(Funnel(tables(spark, sessions, pv, orders))).first()
    assert (r.Sessions, r.Downstream_Completion_Pct, r.AOV) == (4, 50.0, Decimal("60.00"))
    assert r.Estimated_Revenue == Decimal("3.00")


def test_retarget_pool_hand_computed(spark):
    # two non-converters seen 10 and 200 days before the data end; one converter (AOV 50.00).
    # pool 1 x 5 % x 50.00 = 2.50
    sessions = [_s(1, 1, t="2024-06-21 00:00:00"), _s(2, 2, t="2023-12-13 00:00:00"), _s(3, 3, t="2024-07-01 00:00:00")]
    pv = [(1, ts("2024-06-21 00:00:00"), 1, "/home"), (2, ts("2023-12-13 00:00:00"), 2, "/home"),
          (3, ts("2024-07-01 00:00:00"), 3, "/home")]
    orders = [(9, ts("2024-07-01 00:00:00"), 3, 3, 1, 1, 50.0, 20.0)]
    r = derived.retarget_pool(Funnel(tables(spark, sessions, pv, orders))).first()
    assert (r.Pool_Users, r.AOV, r.Estimated_Revenue) == (1, Decimal("50.00"), Decimal("2.50"))


def test_aov_uplift_hand_computed(spark):
    orders = [(1, ts(T0), 1, 1, 1, 1, 50.82, 20.0), (2, ts(T0), 2, 2, 1, 2, 89.25, 30.0)]
    r = derived.aov_uplift(Funnel(tables(spark, orders=orders))).first()
    # 89.25 / 50.82 - 1 = 75.62 %
    assert (r.AOV_Single, r.AOV_Two, r.AOV_Uplift_Pct) == (50.82, 89.25, 75.62)


def test_foregone_revenue_hand_computed(spark):
    # Lander-5: sessions in Jan and Mar (2 month boundaries), revenue 100.00 -> 50.00 a month.
    # The data runs Jan -> Apr (3 boundaries): 150.00 over the period, 50.00 foregone.
    sessions = [_s(1, 1, t="2024-01-10 00:00:00"), _s(2, 2, t="2024-03-10 00:00:00"),
                _s(3, 3, t="2024-01-01 00:00:00"), _s(4, 4, t="2024-04-01 00:00:00")]
    pv = [(1, ts("2024-01-10 00:00:00"), 1, "/lander-5"), (2, ts("2024-03-10 00:00:00"), 2, "/lander-5"),
          (3, ts("2024-01-01 00:00:00"), 3, "/home"), (4, ts("2024-04-01 00:00:00"), 4, "/home")]
    orders = [(1, ts("2024-01-10 00:00:00"), 1, 1, 1, 1, 60.0, 20.0), (2, ts("2024-03-10 00:00:00"), 2, 2, 1, 1, 40.0, 15.0)]
    items = [(1, ts("2024-01-10 00:00:00"), 1, 1, 1, 60.0, 20.0), (2, ts("2024-03-10 00:00:00"), 2, 1, 1, 40.0, 15.0)]
    r = derived.foregone_revenue(Funnel(tables(spark, sessions, pv, orders, items))).first()
    assert (r.Landing_Page, r.Revenue, r.Months_Active, r.Period_Months) == ("Lander-5", Decimal("100.00"), 2, 3)
    assert (r.Monthly_Revenue, r.Full_Period_Revenue, r.Foregone_Revenue) == \
        (Decimal("50.00"), Decimal("150.00"), Decimal("50.00"))


def test_device_gap_hand_computed(spark):
    # desktop: 10 reach shipping, 8 billing (80 %), 4 buy (50 % after billing);
    # mobile: 10 reach shipping, 6 billing (60 %), 3 buy (50 %). AOV 50.00, one month of data.
    # mobile: 10 x 20 pp x 50 % x 50.00 x 0.5 x 12 / 1 = 300.00 a year.
    sessions, pv, orders = [], [], []
    n = 0
    for dev, base, bill, buy in (("desktop", 0, 8, 4), ("mobile", 100, 6, 3)):
        for i in range(10):
            sid = base + i
            sessions.append(_s(sid, sid, dev))
            pv.append((n, ts(T0), sid, "/shipping")); n += 1
            if i < bill:
                pv.append((n, ts("2024-01-05 10:01:00"), sid, "/billing")); n += 1
            if i < buy:
                pv.append((n, ts("2024-01-05 10:02:00"), sid, "/thank-you-for-your-order")); n += 1
                orders.append((sid, ts(T0), sid, sid, 1, 1, 50.0, 20.0))
    got = {r.device_type: r for r in derived.device_gap(Funnel(tables(spark, sessions, pv, orders))).collect()}
    assert got["mobile"].Gap_pp == 20.0 and got["mobile"].Annual_Estimate == Decimal("300.00")
    assert got["desktop"].Annual_Estimate == Decimal("0.00") and got["mobile"].Period_Months == 1
