"""Adapters: the driver's tables -> the six funnel tables.

No funnel data ships with the analysis, so deterministic mappings turn
the driver's tables into ``sessions, pageviews, orders, order_items,
order_item_refunds, products``:

- ``clickstream`` (fixture A) from ``events``: sessions are user-days,
  pageviews are events, orders are sessions with a large purchase.
- ``journey`` (fixture B) from TPC-H ``orders``: one session per order row,
  spread over years, so attribution, cohorts and recency are exercised.
- ``years`` (fixture D): the clickstream with each user's events moved by up to
  14 periods of 30 days, so that it spans the landing-page split date, and with
  flaws that the quality checks must find.
- ``basket`` (fixture C) from ``orders``, ``lineitem`` and ``part``: order
  lines as order items, at volume.

Every mapping is a plain DataFrame plan without windows: per-group "first row"
picks are minima of one packed number, hash-aggregated and combined map-side,
so a session or user holding a large share of all rows never lands whole in
one task.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickpath.functions.metrics import MONEY
from clickpath.functions.packed import DOUBLE_END, double_order, micros, packed_code, packed_id, packed_key
from clickpath.operators.cleaning import clean_sessions, with_gross_profit, with_page_name
from clickpath.sources.tables import read_table
from clickpath.spec import DEFAULT_SPEC, PRODUCT_NAMES, FunnelSpec

# ---------------------------------------------------------------------------
# Fixed values of the adapters (they define the fixtures; the oracle SQL in
# clickpath.oracle.fixtures states the same values).
# ---------------------------------------------------------------------------
EVENTS_EPOCH = "2024-01-01"          # day 0 of the events table
SESSION_DAY_FACTOR = 4194304         # session id = user_id * 2**22 + day + 2**20: one id per (user, day) for
SESSION_DAY_OFFSET = 1048576         # every date that a timestamp can hold
DAY_MICROS = 86_400_000_000
FIRST_K_CODES = 104                  # folded k of a session's first event: -11..90, shifted, and 0 for none
ORDER_VALUE_THRESHOLD = 150          # a purchase event at least this large makes an order
REFUND_MODULUS = 7                   # items with k % 7 = 0 are refunded
REFUND_DELAY_DAYS = 5
YEARS_BACK_DAYS = 3650               # years fixture: days back, then up to 14 periods of 30 days forward by user
YEARS_PERIODS, YEARS_PERIOD_DAYS = 15, 30
FLAW_K, FLAW_URL = 61, "/odd-page/x" # years fixture: events with this k are views of an unexpected page
FLAW_ORDERS = 5                      # years fixture: orders with id % 5 = 0 are a cent off their items
CONVERTING_PRIORITY = "1-URGENT"     # journey fixture: converting sessions
PRODUCT_LAUNCHES = ("2023-03-01", "2023-06-01", "2023-09-01", "2023-12-01")

_PRODUCT_SCHEMA = T.StructType([
    T.StructField("product_id", T.IntegerType(), False),
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("product_name", T.StringType(), False),
])


def catalogue(spark: SparkSession) -> DataFrame:
    """The four-row product dimension (bounded size: safe to broadcast)."""
    rows = [(pid, datetime.fromisoformat(launch), name)
            for (pid, name), launch in zip(PRODUCT_NAMES, PRODUCT_LAUNCHES)]
    return spark.createDataFrame(rows, _PRODUCT_SCHEMA)


def _finish(tables: dict) -> dict:
    """Keep the raw tables under ``raw_<name>`` and apply the ingest derivations."""
    for name in list(tables):
        tables[f"raw_{name}"] = tables[name]
    tables["sessions"] = clean_sessions(tables["sessions"])
    tables["pageviews"] = with_page_name(tables["pageviews"])
    tables["orders"] = with_gross_profit(tables["orders"])
    tables["order_items"] = with_gross_profit(tables["order_items"])
    return tables


# ---------------------------------------------------------------------------
# A. clickstream
# ---------------------------------------------------------------------------

def props_k(col: str = "props"):
    """Integer ``k`` of the JSON ``props``; NULL where it is missing or no integer."""
    return F.from_json(F.col(col), "k INT").getField("k")


def years(events: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> dict:
    days = F.coalesce(F.col("user_id") % YEARS_PERIODS, F.lit(0)).cast("int") * YEARS_PERIOD_DAYS - YEARS_BACK_DAYS
    return clickstream(events.withColumn("ts", F.col("ts") + F.make_dt_interval(days)), spec, flawed=True)


def clickstream(events: DataFrame, spec: FunnelSpec = DEFAULT_SPEC, flawed: bool = False) -> dict:
    spark = events.sparkSession
    ev = events.select(
        "event_id", "ts", "user_id", "event_type", "value",
        props_k().alias("k"),
    ).withColumn(
        "sid",
        F.col("user_id").cast("bigint") * SESSION_DAY_FACTOR
        + F.datediff(F.to_date("ts"), F.lit(EVENTS_EPOCH).cast("date")) + SESSION_DAY_OFFSET,
    )

    # First event of each session: one packed minimum. All that the rules below read of the first event's k
    # are comparisons with 50 to 90 and remainders by 2 and 3, so k beyond 0..90 is folded to a value that
    # agrees in all of them; the folded k is carried as the code. A session is one day, so its time has room.
    folded = (F.when(F.col("k") > 90, 90).when(F.col("k") < 0, F.col("k") % 6 - 6).otherwise(F.col("k")))
    code = F.coalesce(folded + 13, F.lit(0))
    clock = micros("ts", events.schema["ts"].dataType) % DAY_MICROS
    first = (ev.groupBy("sid")
             .agg(F.min("ts").alias("first_ts"), F.max("user_id").alias("first_user"),
                  F.min(packed_key(clock, F.col("event_id"), code, FIRST_K_CODES, most=DAY_MICROS)).alias("f"))
             .select("sid", "first_ts", packed_id(F.col("f"), FIRST_K_CODES).alias("first_event_id"),
                     F.nullif(packed_code(F.col("f"), FIRST_K_CODES), F.lit(0)).alias("first_code"), "first_user")
             .select("sid", "first_ts", "first_event_id", (F.col("first_code") - 13).alias("first_k"), "first_user"))

    # Sessions: attributes from the first event; repeat unless it is the user's first session.
    # The user's first session comes from the session-grain table (one row per session), and the
    # left join on a per-user aggregate is dropped by Catalyst when a report does not read the flag.
    # Keyed by struct(user): struct equality is null-safe (NULL users form one user, as in SQL
    # GROUP BY), and unlike <=> it still lets the optimizer remove the join when it is unused.
    user_first = first.groupBy(F.struct("first_user").alias("uf_user")).agg(F.min("sid").alias("user_first_sid"))
    day = F.col("sid") - F.col("first_user") * SESSION_DAY_FACTOR - SESSION_DAY_OFFSET
    k = F.col("first_k")
    source = F.when(k < 50, "s_a").when(k < 70, "s_b").when(k < 80, "s_c")
    sessions = (
        first.join(user_first, F.struct(first["first_user"]) == user_first["uf_user"], "left")
        .select(
            F.col("sid").alias("website_session_id"),
            F.col("first_ts").alias("created_at"),
            F.col("first_user").alias("user_id"),
            F.when(F.col("sid") == F.col("user_first_sid"), 0).otherwise(1).alias("is_repeat_session"),
            source.alias("utm_source"),
            F.when(source.isNotNull(), F.when(k % 2 == 1, "brand").otherwise("nonbrand")).alias("utm_campaign"),
            F.when(source.isNotNull(), F.concat(F.lit("ad_"), (k % 3).cast("string"))).alias("utm_content"),
            F.when((F.col("first_user") + day) % 3 == 0, "mobile").otherwise("desktop").alias("device_type"),
            F.when(k < 90, "https://ref").alias("http_referer"),
        )
    )

    # Pageviews: one per event, URL by a first-match rule.
    landing_urls = F.array(*[F.lit(u) for u in spec.landing_urls])
    product_urls = F.array(*[F.lit(u) for u in spec.product_urls])
    pv = ev.join(first.select("sid", "first_event_id"), "sid")
    ek = F.col("k")
    url = (
        F.when((F.col("event_type") == "purchase") & (F.col("value") >= ORDER_VALUE_THRESHOLD), spec.thank_you_url)
        .when((F.col("event_id") == F.col("first_event_id")) & (ek % 8 < len(spec.landing_urls)),
              F.element_at(landing_urls, (ek % 8 + 1).cast("int")))
        .when(F.col("event_type") == "view", spec.products_url)
        .when(F.col("event_type") == "click", F.element_at(product_urls, (ek % 4 + 1).cast("int")))
        .when(F.col("event_type") == "signup", spec.cart_url)
        .when(F.col("event_type") == "error", spec.shipping_url)
        .when(ek % 2 == 0, spec.billing_urls[0])
        .otherwise(spec.billing_urls[1])
    )
    if flawed:
        url = F.when(ek == FLAW_K, FLAW_URL).otherwise(url)
    pageviews = pv.select(
        F.col("event_id").alias("website_pageview_id"),
        F.col("ts").alias("created_at"),
        F.col("sid").alias("website_session_id"),
        url.alias("pageview_url"),
    )

    # Order items: all purchases of each session whose largest is >= threshold; the largest is the primary
    # one (the smallest event id breaks ties). It is a packed minimum joined back, so a hot session is combined
    # map-side and can be split. Prices are decimal(18,2), so values stay far below 2^63.
    purchases = ev.filter(F.col("event_type") == "purchase")
    largest = (purchases.filter(F.col("value") >= ORDER_VALUE_THRESHOLD)
               .groupBy(F.col("sid").alias("largest_sid"))
               .agg(F.min(packed_key(DOUBLE_END - double_order(F.col("value")), F.col("event_id"))).alias("p"))
               .select("largest_sid", packed_id(F.col("p")).alias("primary_event_id")))
    top = (purchases.join(largest, F.col("sid") == F.col("largest_sid"))
           .withColumn("item_rank", F.when(F.col("event_id") == F.col("primary_event_id"), 1).otherwise(2))
           .withColumn("price_usd", F.col("value").cast(MONEY))
           .withColumn("cogs_usd", F.expr("round(price_usd * (0.30 + 0.02 * (k % 4)), 2)").cast(MONEY))
           .withColumn("product_id", (F.col("k") % 4 + 1).cast("int")))
    order_items = top.select(
        F.col("event_id").alias("order_item_id"),
        F.col("ts").alias("created_at"),
        F.col("sid").alias("order_id"),
        "product_id",
        F.when(F.col("item_rank") == 1, 1).otherwise(0).alias("is_primary_item"),
        "price_usd", "cogs_usd",
    )
    orders = top.groupBy(F.col("sid").alias("order_id")).agg(
        F.min(F.when(F.col("value") >= ORDER_VALUE_THRESHOLD, F.col("ts"))).alias("created_at"),
        F.max("user_id").alias("user_id"),
        F.max(F.when(F.col("item_rank") == 1, F.col("product_id"))).alias("primary_product_id"),
        F.count(F.lit(1)).cast("int").alias("items_purchased"),
        F.sum("price_usd").cast(MONEY).alias("price_usd"),
        F.sum("cogs_usd").cast(MONEY).alias("cogs_usd"),
    ).select("order_id", "created_at", F.col("order_id").alias("website_session_id"), "user_id",
             "primary_product_id", "items_purchased", "price_usd", "cogs_usd")
    if flawed:
        orders = orders.withColumn("price_usd", (F.col("price_usd") + F.when(F.col("order_id") % FLAW_ORDERS == 0, F.lit("0.01")).otherwise("0").cast(MONEY)).cast(MONEY))
    refunds = top.filter(F.col("k") % REFUND_MODULUS == 0).select(
        F.col("event_id").alias("order_item_refund_id"),
        (F.col("ts") + F.expr(f"INTERVAL {REFUND_DELAY_DAYS} DAYS")).alias("created_at"),
        F.col("event_id").alias("order_item_id"),
        F.col("sid").alias("order_id"),
        F.col("price_usd").alias("refund_amount_usd"),
    )
    return _finish({
        "sessions": sessions, "pageviews": pageviews, "orders": orders,
        "order_items": order_items, "order_item_refunds": refunds, "products": catalogue(spark),
    })


# ---------------------------------------------------------------------------
# B. journey
# ---------------------------------------------------------------------------

def _journey_sessions(orders: DataFrame) -> DataFrame:
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    first = (o.groupBy(F.struct("o_custkey").alias("cust"))
             .agg(F.min(packed_key(micros("o_orderdate", o.schema["o_orderdate"].dataType), F.col("o_orderkey"))).alias("f"))
             .select("cust", packed_id(F.col("f")).alias("first_key")))
    # struct key: null-safe, and removable by the optimizer when is_repeat_session is not read
    return o.join(first, F.struct(o["o_custkey"]) == first["cust"], "left").select(
        F.col("o_orderkey").alias("website_session_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderkey") == F.col("first_key"), 0).otherwise(1).alias("is_repeat_session"),
        F.col("o_orderstatus").alias("utm_source"),
        F.col("o_orderpriority").alias("utm_campaign"),
        F.concat(F.lit("ad_"), (F.col("o_orderkey") % 3).cast("string")).alias("utm_content"),
        F.when(F.col("o_orderkey") % 5 == 0, "mobile").otherwise("desktop").alias("device_type"),
        F.lit("https://ref").alias("http_referer"),
    )


def _journey_pageviews(orders: DataFrame, spec: FunnelSpec) -> DataFrame:
    url = (F.when(F.col("o_orderpriority") == CONVERTING_PRIORITY, spec.thank_you_url)
           .when(F.col("o_orderstatus") == "F", spec.cart_url)
           .when(F.col("o_orderstatus") == "O", spec.products_url)
           .otherwise(spec.product_urls[0]))
    return orders.select(
        F.col("o_orderkey").alias("website_pageview_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderkey").alias("website_session_id"),
        url.alias("pageview_url"),
    )


def journey(orders: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> dict:
    spark = orders.sparkSession
    conv = (orders.filter(F.col("o_orderpriority") == CONVERTING_PRIORITY)
            .withColumn("price_usd", F.col("o_totalprice").cast(MONEY))
            .withColumn("cogs_usd", F.expr("round(price_usd * 0.4, 2)").cast(MONEY))
            .withColumn("product_id", (F.col("o_orderkey") % 4 + 1).cast("int")))
    f_orders = conv.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("created_at"),
        F.col("o_orderkey").alias("website_session_id"), F.col("o_custkey").alias("user_id"),
        F.col("product_id").alias("primary_product_id"), F.lit(1).alias("items_purchased"),
        "price_usd", "cogs_usd",
    )
    items = conv.select(
        F.col("o_orderkey").alias("order_item_id"), F.col("o_orderdate").alias("created_at"),
        F.col("o_orderkey").alias("order_id"), "product_id", F.lit(1).alias("is_primary_item"),
        "price_usd", "cogs_usd",
    )
    refunds = conv.filter(F.col("o_orderkey") % REFUND_MODULUS == 0).select(
        F.col("o_orderkey").alias("order_item_refund_id"),
        (F.col("o_orderdate") + F.expr(f"INTERVAL {REFUND_DELAY_DAYS} DAYS")).alias("created_at"),
        F.col("o_orderkey").alias("order_item_id"), F.col("o_orderkey").alias("order_id"),
        F.col("price_usd").alias("refund_amount_usd"),
    )
    return _finish({
        "sessions": _journey_sessions(orders), "pageviews": _journey_pageviews(orders, spec),
        "orders": f_orders, "order_items": items, "order_item_refunds": refunds,
        "products": catalogue(spark),
    })


# ---------------------------------------------------------------------------
# C. basket
# ---------------------------------------------------------------------------

def line_id(df: DataFrame):
    """Deterministic row id of a Parquet scan, of fixed width: a 64-bit hash of the file's path, then the row's index in it."""
    df.select("_metadata.row_index", "_metadata.file_path").schema  # analysed, not executed: fails unless files are read
    file = F.xxhash64(F.col("_metadata.file_path")).cast("decimal(19,0)") + F.lit(str(1 << 63)).cast("decimal(19,0)")
    return (file * F.lit(1 << 40) + F.col("_metadata.row_index")).cast("decimal(38,0)")


_LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
               "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def basket(orders: DataFrame, lineitem: DataFrame, part: DataFrame,
           spec: FunnelSpec = DEFAULT_SPEC) -> dict:
    """Order lines as order items; the product is the part type.

    Line ids: lineitem has no key (even all columns together may repeat), so a
    line is identified by where it is stored: Parquet file path (hashed) and row
    index (``_metadata``), packed into one number, so no text id is shuffled. That id is unique, deterministic (it survives recomputation
    after an executor loss and lets Spark reuse exchanges and push filters),
    and needs no shuffle; no result exposes its value. A window numbering would
    put every copy of a repeated line into one task. Inputs that are not a
    file scan fall back to ``monotonically_increasing_id()``.
    """
    lines = (lineitem.select(*_LINE_ORDER, "l_orderkey", line_id(lineitem).alias("order_item_id"))
             .join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type")), "l_partkey"))
    per_order = (lines.groupBy("l_orderkey")
                 .agg(F.count(F.lit(1)).cast("int").alias("n_lines"),
                      F.min(F.struct(*_LINE_ORDER, "order_item_id", "p_type")).alias("f"))
                 .select("l_orderkey", "n_lines",
                         F.col("f.order_item_id").alias("primary_item_id"),
                         F.col("f.p_type").alias("primary_type")))
    # every line has its order in per_order; a left join lets Catalyst drop it when unused
    items = (lines.join(per_order.select("l_orderkey", "primary_item_id"), "l_orderkey", "left")
             .withColumn("price_usd", F.col("l_extendedprice").cast(MONEY))
             .withColumn("cogs_usd", F.expr("round(price_usd * 0.4, 2)").cast(MONEY)))
    order_items = items.select(
        "order_item_id", F.col("l_shipdate").alias("created_at"), F.col("l_orderkey").alias("order_id"),
        F.col("p_type").alias("product_id"),
        F.when(F.col("order_item_id") == F.col("primary_item_id"), 1).otherwise(0).alias("is_primary_item"),
        "price_usd", "cogs_usd",
    )
    refunds = items.filter(F.col("l_returnflag") == "R").select(
        F.col("order_item_id").alias("order_item_refund_id"),
        (F.col("l_shipdate") + F.expr(f"INTERVAL {REFUND_DELAY_DAYS} DAYS")).alias("created_at"),
        "order_item_id", F.col("l_orderkey").alias("order_id"),
        F.col("price_usd").alias("refund_amount_usd"),
    )
    o = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    f_orders = (o.join(per_order, o["o_orderkey"] == per_order["l_orderkey"], "left")
                .select(
                    F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("created_at"),
                    F.col("o_orderkey").alias("website_session_id"), F.col("o_custkey").alias("user_id"),
                    F.col("primary_type").alias("primary_product_id"),
                    F.coalesce(F.col("n_lines"), F.lit(0)).alias("items_purchased"),
                    F.col("o_totalprice").cast(MONEY).alias("price_usd"),
                    F.expr("round(CAST(o_totalprice AS DECIMAL(18,2)) * 0.4, 2)").cast(MONEY).alias("cogs_usd"),
                ))
    products = (part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
                .select(F.col("p_type").alias("product_id"),
                        F.lit(None).cast("timestamp_ntz").alias("created_at"),
                        F.col("p_type").alias("product_name")))
    return _finish({
        "sessions": _journey_sessions(orders), "pageviews": _journey_pageviews(orders, spec),
        "orders": f_orders, "order_items": order_items, "order_item_refunds": refunds,
        "products": products,
    })


FIXTURES = {
    "A": lambda spark, d, spec=DEFAULT_SPEC: clickstream(read_table(spark, d, "events"), spec),
    "D": lambda spark, d, spec=DEFAULT_SPEC: years(read_table(spark, d, "events"), spec),
    "B": lambda spark, d, spec=DEFAULT_SPEC: journey(read_table(spark, d, "orders"), spec),
    "C": lambda spark, d, spec=DEFAULT_SPEC: basket(read_table(spark, d, "orders"), read_table(spark, d, "lineitem"),
                                                    read_table(spark, d, "part"), spec),
}


def fixture_tables(spark: SparkSession, sf_dir: str, fixture: str = "A",
                   spec: FunnelSpec = DEFAULT_SPEC) -> dict:
    """The six funnel tables of one fixture over the driver data in ``sf_dir``.

    The returned DataFrames are lazy plans over the files that are there now.
    """
    return dict(FIXTURES[fixture](spark, sf_dir, spec))
