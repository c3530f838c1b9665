"""Packed order keys against Python tuples, at the ends of their ranges too."""

import datetime as dt
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from clickpath.functions import packed
from clickpath.operators.views import funnel_flags, landing_urls, user_attribution
from helpers import tables, ts

LOW, HIGH = -(1 << 63), (1 << 63) - 1
TIMES = [None, dt.datetime(1, 1, 1), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(1970, 1, 1), dt.datetime(2024, 3, 31, 2, 30),
         dt.datetime(2024, 10, 27, 1, 30), dt.datetime(2024, 10, 27, 2, 30, 0, 1), dt.datetime(9999, 12, 31, 23, 59, 59, 999999)]
IDS = [None, LOW, LOW + 1, -1, 0, 1, HIGH - 1, HIGH]


def _order(v, least):
    return (v is not None, least if v is None else v)


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
@pytest.mark.parametrize("kind", ["timestamp_ntz", "date"])
def test_order_and_round_trip(spark, zone, kind):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rng = random.Random(1)
        rows = [(rng.randrange(20), t if t is None or kind != "date" else t.date(), i, rng.randrange(17)) for t in TIMES for i in IDS for _ in range(3)]
        df = spark.createDataFrame(rows, f"g int, t {kind}, i long, c int")
        key = packed.packed_key(packed.micros("t", df.schema["t"].dataType), F.col("i"), F.col("c"), packed.MAX_CODES)
        got = df.groupBy("g").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
        got = got.select("g", *[f(F.col(c), packed.MAX_CODES).alias(c + n) for c in ("lo", "hi") for f, n in ((packed.packed_id, "i"), (packed.packed_code, "c"))]).collect()
        least = dt.date.min if kind == "date" else dt.datetime.min
        for r in got:
            mine = sorted((_order(t, least), _order(i, 0), c, i) for g, t, i, c in rows if g == r["g"])
            assert (r["loi"], r["loc"], r["hii"], r["hic"]) == (mine[0][3], mine[0][2], mine[-1][3], mine[-1][2])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_zoned_timestamps_and_limits(spark):
    df = spark.sql("SELECT * FROM VALUES (timestamp'0001-01-01 00:00:00', 5L), (timestamp'9999-12-31 23:59:59.999999', -5L) AS t(t, i)")
    key = packed.packed_key(packed.micros("t", df.schema["t"].dataType), F.col("i"))
    assert [r[0] for r in df.orderBy(key).select(packed.packed_id(key)).collect()] == [5, -5]
    assert packed.MAX_CODES == 17
    with pytest.raises(ValueError):
        packed.packed_key(F.lit(1), F.lit(1), F.lit(0), 18)


def test_double_order_is_exact(spark):
    rng = random.Random(4)
    values = [1.0, 2.0 ** 62, 150.0, 1e16] + [math.nextafter(2.0 ** e, d) for e in range(1, 63) for d in (0.0, math.inf)] + [2.0 ** e for e in range(63)]
    values += [rng.uniform(1, 10) ** rng.randint(1, 15) for _ in range(2000)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", packed.double_order(F.col("v")).alias("o")).collect()
    bits = lambda v: struct.unpack("<q", struct.pack("<d", v))[0] - (1023 << 52)
    assert all(r["o"] == bits(r["v"]) < packed.DOUBLE_END for r in got)


def test_landing_urls_keep_unknown_ones(spark):
    t0, t1 = ts("2024-01-05 10:00:00"), ts("2024-01-05 10:00:01")
    t = tables(spark, pageviews=[(2, t0, 10, "/odd?x=1"), (3, t0, 10, "/home"), (1, t1, 10, "/cart"), (4, t0, 11, "/lander-5"), (5, None, 12, "/first"), (6, t0, 12, "/home")])
    flags = funnel_flags(t["pageviews"])
    assert {r[0]: r[1] for r in landing_urls(flags, t["pageviews"]).collect()} == {10: "/odd?x=1", 11: "/lander-5", 12: "/first"}
    assert {r["website_session_id"]: r["Landing_Page"] for r in flags.collect()} == {10: None, 11: "Lander-5", 12: None}


def test_touches_of_a_hot_user(spark):
    """One user holds a third of the sessions; ids run against time, so ties and order both count."""
    n = 3000
    s = spark.range(n).select(
        (n - F.col("id")).alias("website_session_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0, cast(id div 2 as int))").alias("created_at"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 200 + 100).cast("long").alias("user_id"), F.lit("a").alias("utm_source"), F.lit("b").alias("utm_campaign"),
        F.concat(F.lit("c"), F.col("id")).alias("utm_content"), F.lit("d").alias("device_type"), F.lit("e").alias("traffic_channel"))
    orders = s.where("website_session_id % 5 = 0").select("user_id", "created_at", "website_session_id")
    rows = s.collect()
    for touch, pick in (("first_order", min), ("last_order", max)):
        got = {r["user_id"]: r for r in user_attribution(s, orders, touch).collect()}
        assert set(got) == {r["user_id"] for r in rows}
        for user, r in got.items():
            mine = [x for x in rows if x["user_id"] == user]
            first = min(mine, key=lambda x: (x["created_at"], x["website_session_id"]))
            assert (r["first_touch_website_session_id"], r["first_touch_utm_content"]) == (first["website_session_id"], first["utm_content"])
            bought = [x for x in mine if x["website_session_id"] % 5 == 0]
            want = pick(bought, key=lambda x: (x["created_at"], x["website_session_id"])) if bought else None
            assert r["last_touch_website_session_id"] == (want and want["website_session_id"]) and r["last_touch_utm_content"] == (want and want["utm_content"])
