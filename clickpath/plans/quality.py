"""Ingest checks, data-quality checks and exploratory profiles of the six tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpath.functions.metrics import MONEY, exact_mean, money_per_unit, month_diff, month_floor, pct
from clickpath.operators import quality as dq
from clickpath.operators.collation import collated, folded
from clickpath.operators.views import landing_urls
from clickpath.plans.context import Funnel
from clickpath.plans.registry import analysis
from clickpath.spec import PRODUCT_NAMES, UNTRACKED_LABEL

TABLES = ("sessions", "pageviews", "orders", "order_items", "order_item_refunds", "products")
KEYS = {
    "sessions": ("website_session_id", "user_id"),
    "pageviews": ("website_pageview_id", "website_session_id"),
    "orders": ("order_id", "website_session_id"),
    "order_items": ("order_item_id", "order_id"),
    "order_item_refunds": ("order_item_refund_id", "order_item_id"),
    "products": ("product_id", None),
}


@analysis("dq_profile", "A")
def profile(f: Funnel) -> DataFrame:
    """Per table and column: NULL count and row count, on the raw tables."""
    return dq.union_all([dq.null_profile(f[f"raw_{t}"], t) for t in TABLES])


@analysis("dq_preview_sessions", "A")
def preview_sessions(f: Funnel) -> DataFrame:
    """First three sessions by id."""
    return dq.preview(f["raw_sessions"], "website_session_id", 3)


@analysis("dq_preview_refunds_tail", "A")
def preview_refunds_tail(f: Funnel) -> DataFrame:
    """Last five refunds by refund id."""
    return dq.preview(f["raw_order_item_refunds"], "order_item_refund_id", 5, last=True)


@analysis("dq_key_overview", "A")
def key_overview(f: Funnel) -> DataFrame:
    """Per table: rows, columns, distinct primary keys, distinct foreign keys."""
    return dq.union_all([dq.key_overview(f[f"raw_{t}"], t, *KEYS[t]) for t in TABLES])


@analysis("dq_date_ranges", "A", also=("B",))
def date_ranges(f: Funnel) -> DataFrame:
    """Per table: first and last date of ``created_at``."""
    return dq.union_all([
        f[t].agg(F.to_date(F.min("created_at")).alias("min_date"), F.to_date(F.max("created_at")).alias("max_date"))
        .select(F.lit(t).alias("table_name"), "min_date", "max_date") for t in TABLES])


@analysis("eda_pageviews_per_session", "A")
def pageviews_per_session(f: Funnel) -> DataFrame:
    per = f["pageviews"].groupBy("website_session_id").agg(F.count(F.lit(1)).alias("c"))
    g = per.agg(F.min("c").alias("min_views"), F.max("c").alias("max_views"),
                F.sum("c").alias("t"), F.count(F.lit(1)).alias("n"))
    return g.select("min_views", "max_views", exact_mean("t", "n").alias("mean_views"))


@analysis("eda_session_conversion", "A")
def session_conversion(f: Funnel) -> DataFrame:
    """Distinct sessions with an order, all sessions, session conversion %."""
    with_orders = f["orders"].agg(F.count_distinct("website_session_id").alias("sessions_with_orders"))
    total = f["sessions"].agg(F.count(F.lit(1)).alias("total_sessions"))
    g = with_orders.select("sessions_with_orders", total.scalar().alias("total_sessions"))
    return g.select("sessions_with_orders", "total_sessions",
                    pct("sessions_with_orders", "total_sessions").alias("session_conversion_pct"))


@analysis("eda_items_per_order", "A", also=("C",))
def items_per_order(f: Funnel) -> DataFrame:
    """Items per order -> orders (from the item table)."""
    per = f["order_items"].groupBy("order_id").agg(F.count(F.lit(1)).alias("items_per_order"))
    return per.groupBy("items_per_order").agg(F.count(F.lit(1)).alias("order_count"))


@analysis("eda_sessions_per_user", "A")
def sessions_per_user(f: Funnel) -> DataFrame:
    g = f["sessions"].agg(F.count_distinct("user_id").alias("unique_users"), F.count(F.lit(1)).alias("sessions"))
    return g.select("unique_users", "sessions", exact_mean("sessions", "unique_users").alias("avg_sessions_per_user"))


@analysis("eda_cross_sell_rate", "A", also=("C",))
def cross_sell_rate(f: Funnel) -> DataFrame:
    g = f["orders"].agg(F.count_if(F.col("items_purchased") == 2).alias("two_item_orders"),
                        F.count(F.lit(1)).alias("orders"))
    return g.select("two_item_orders", "orders", pct("two_item_orders", "orders").alias("cross_sell_pct"))


@analysis("eda_monthly_sessions", "A", also=("B",))
def monthly_sessions(f: Funnel) -> DataFrame:
    return f["sessions"].groupBy(month_floor("created_at").alias("month")).agg(F.count(F.lit(1)).alias("sessions"))


@analysis("eda_traffic_sources", "A")
def traffic_sources(f: Funnel) -> DataFrame:
    """Raw ``utm_source`` counts, NULL kept and shown as an untracked label."""
    vc = dq.value_counts(f["raw_sessions"], "utm_source", "sessions", dropna=False)
    return vc.select(F.coalesce("utm_source", F.lit(UNTRACKED_LABEL)).alias("utm_source_label"), "sessions")


@analysis("eda_device_split", "A")
def device_split(f: Funnel) -> DataFrame:
    from clickpath.operators.funnel import share_of_total
    return share_of_total(dq.value_counts(f["sessions"], "device_type", "sessions"), "sessions", "pct")


@analysis("eda_top_pages", "A")
def top_pages(f: Funnel) -> DataFrame:
    """Ten most viewed URLs (ties by URL), with a short label."""
    vc = dq.value_counts(f["pageviews"], "pageview_url", "views")
    short = F.replace(F.replace(F.col("pageview_url"), F.lit("/"), F.lit("")), F.lit("the-"), F.lit(""))
    return (vc.orderBy(F.col("views").desc(), F.col("pageview_url")).limit(10)
            .select("pageview_url", short.alias("short_label"), "views"))


@analysis("eda_order_value_hist", "A", also=("C",))
def order_value_hist(f: Funnel, bins: int = 30) -> DataFrame:
    """Equal-width histogram of order value: bin 1..bins (the last bin closed), exact in cents."""
    o = f["orders"].select((F.col("price_usd") * 100).cast("bigint").alias("c")).filter(F.col("c").isNotNull())
    lo_hi = o.agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    lo, hi = lo_hi.select("lo").scalar(), lo_hi.select("hi").scalar()
    b = F.least(F.expr(f"((c - lo) * {bins}) div nullif(hi - lo, 0)") + 1, F.lit(bins))
    return (o.withColumn("lo", lo).withColumn("hi", hi).withColumn("bin", b.cast("bigint"))
            .groupBy("bin").agg(F.count(F.lit(1)).alias("order_count")))


@analysis("eda_monthly_orders", "A", also=("B",))
def monthly_orders(f: Funnel) -> DataFrame:
    return f["orders"].groupBy(month_floor("created_at").alias("month")).agg(F.count(F.lit(1)).alias("orders"))


@analysis("clean_traffic_channel", "A", also=("B",))
def traffic_channel(f: Funnel) -> DataFrame:
    """Distribution of the derived channel (derived before the 'none' fill)."""
    return dq.value_counts(f["sessions"], "traffic_channel", "sessions")


@analysis("clean_fill_none", "A")
def fill_none(f: Funnel) -> DataFrame:
    """NULLs per column of the cleaned sessions (expected 0 in the filled columns)."""
    return dq.null_profile(f["sessions"], "sessions")


@analysis("dq_duplicates", "A", also=("C",))
def duplicates(f: Funnel) -> DataFrame:
    return dq.union_all([dq.duplicate_keys(f[t], t, KEYS[t][0]) for t in TABLES[:5]])


@analysis("eda_session_categoricals", "A")
def session_categoricals(f: Funnel) -> DataFrame:
    s = f["sessions"]
    return dq.union_all([
        dq.value_counts(s, c, "sessions").select(F.lit(c).alias("column_name"),
                                                 F.col(c).cast("string").alias("value"), "sessions")
        for c in ("utm_campaign", "device_type", "is_repeat_session")])


@analysis("dq_repeat_flag", "A", also=("B",))
def repeat_flag(f: Funnel) -> DataFrame:
    """Users with a repeat-flagged session but only one session (expected 0)."""
    per_user = f["sessions"].groupBy("user_id").agg(F.max("is_repeat_session").alias("rep"),
                                                    F.count("website_session_id").alias("c"))
    return per_user.agg(F.count_if((F.col("rep") == 1) & (F.col("c") == 1))
                        .alias("repeat_users_with_single_session"))


@analysis("clean_page_name", "A", also=("B",))
def page_name(f: Funnel) -> DataFrame:
    """URL -> derived page name, with views."""
    return f["pageviews"].groupBy("pageview_url", "page_name").agg(F.count(F.lit(1)).alias("views"))


@analysis("dq_page_domain", "A", also=("B", "D"))
def page_domain(f: Funnel) -> DataFrame:
    """Page names outside the expected set, with views (expected none)."""
    pv = f["pageviews"].filter(~F.coalesce(F.col("page_name").isin(*f.spec.known_page_names), F.lit(False)))
    return dq.value_counts(pv, "page_name", "views", dropna=False)


@analysis("eda_page_views_collated", "A", also=("D",))
def page_views_collated(f: Funnel) -> DataFrame:
    """Views per URL where case and trailing blanks do not count, and whether the URL is a known one.

    The URLs are read as a careless tracker writes them: upper case in views with an odd id,
    and up to two blanks behind. Grouping, membership and the join with the sessions' landing
    URLs all go by the column's collation.
    """
    urls = f.spec.landing_urls + f.spec.product_urls + f.spec.billing_urls + (f.spec.products_url, f.spec.cart_url, f.spec.shipping_url, f.spec.thank_you_url)
    view = F.col("website_pageview_id")
    typed = F.concat(F.when(view % 2 == 1, F.upper("pageview_url")).otherwise(F.col("pageview_url")), F.repeat(F.lit(" "), (view % 3).cast("int")))
    pv = collated(f["pageviews"].select(typed.alias("url")), ["url"])
    g = pv.groupBy("url").agg(F.count(F.lit(1)).alias("views"))
    landed = landing_urls(f.flags, f["pageviews"]).groupBy("landing_url").agg(F.count(F.lit(1)).alias("landings"))
    g = g.join(collated(landed, ["landing_url"]), F.col("url") == F.col("landing_url"), "left")
    return g.select(folded("url").alias("url"), "views", F.col("url").isin(*urls).alias("known"), F.coalesce("landings", F.lit(0)).alias("landings"))


@analysis("eda_page_counts", "A", also=("B",))
def page_counts(f: Funnel) -> DataFrame:
    return dq.value_counts(f["pageviews"], "page_name", "views")


@analysis("clean_gross_profit", "A", also=("C",))
def gross_profit(f: Funnel) -> DataFrame:
    """Totals of price, cost and the derived gross profit, orders and items."""
    return dq.union_all([
        f[t].agg(F.sum("price_usd").cast(MONEY).alias("price_total"), F.sum("cogs_usd").cast(MONEY).alias("cogs_total"),
                 F.sum("gross_profit").cast(MONEY).alias("gross_profit_total"))
        .select(F.lit(t).alias("table_name"), "price_total", "cogs_total", "gross_profit_total")
        for t in ("orders", "order_items")])


def _counts(col: str, table: str):
    def run(f: Funnel) -> DataFrame:
        return dq.value_counts(f[table], col, "n")
    run.__name__ = f"value_counts_{col}"
    run.__doc__ = f"Rows of ``{table}`` per non-NULL ``{col}``."
    return run


analysis("eda_orders_by_product", "A", also=("C",))(_counts("primary_product_id", "orders"))
analysis("eda_items_distribution", "A", also=("C",))(_counts("items_purchased", "orders"))
analysis("eda_primary_flag", "A", also=("C",))(_counts("is_primary_item", "order_items"))


@analysis("eda_order_describe", "A", also=("C",))
def order_describe(f: Funnel) -> DataFrame:
    return dq.describe(f["orders"], "orders", ["price_usd", "cogs_usd", "gross_profit"])


@analysis("eda_refund_describe", "A", also=("C",))
def refund_describe(f: Funnel) -> DataFrame:
    return dq.describe(f["order_item_refunds"], "order_item_refunds", ["refund_amount_usd"])


@analysis("dq_positive_amounts", "A", also=("C",))
def positive_amounts(f: Funnel) -> DataFrame:
    """Zero, negative or NULL prices and costs in orders and items (expected 0)."""
    return dq.union_all([dq.violations(f[t], f"{c}_positive", t, F.col(c) > 0)
                         for t in ("orders", "order_items") for c in ("price_usd", "cogs_usd")])


@analysis("eda_product_means", "A", also=("C",))
def product_means(f: Funnel) -> DataFrame:
    """Per product: mean item price, cost and gross profit, to the cent."""
    g = f["order_items"].groupBy("product_id").agg(
        F.count("price_usd").alias("np"), F.sum("price_usd").alias("sp"),
        F.count("cogs_usd").alias("nc"), F.sum("cogs_usd").alias("sc"),
        F.count("gross_profit").alias("ng"), F.sum("gross_profit").alias("sg"))
    return g.select("product_id", money_per_unit("sp", "np").alias("mean_price"),
                    money_per_unit("sc", "nc").alias("mean_cogs"), money_per_unit("sg", "ng").alias("mean_gross_profit"))


def _reconciliation(f: Funnel, how: str) -> DataFrame:
    totals = f["order_items"].groupBy("order_id").agg(F.sum("price_usd").alias("item_total"))
    r = f["orders"].select("order_id", "price_usd").join(totals, "order_id", how)
    r = r.withColumn("difference", (F.col("price_usd") - F.col("item_total")).cast(MONEY))
    # A missing side is a mismatch in the outer variant; in the inner one it cannot occur.
    return r.filter(F.coalesce(F.col("difference") != 0, F.lit(True))).select(
        "order_id", F.col("price_usd").cast(MONEY).alias("price_usd"),
        F.col("item_total").cast(MONEY).alias("item_total"), "difference")


@analysis("dq_price_reconciliation", "A", also=("C", "D"))
def price_reconciliation(f: Funnel) -> DataFrame:
    """Orders whose total differs from the sum of their items (orders with items only)."""
    return _reconciliation(f, "inner")


@analysis("dq_price_reconciliation_outer", "C", also=("A",))
def price_reconciliation_outer(f: Funnel) -> DataFrame:
    """Same over a full outer join: orders without items and items without orders are reported too."""
    return _reconciliation(f, "full_outer")


@analysis("eda_refund_counts", "A", also=("C",))
def refund_counts(f: Funnel) -> DataFrame:
    return f["order_item_refunds"].agg(F.count(F.lit(1)).alias("total_refunds"),
                                       F.count_distinct("order_id").alias("refunded_orders"))


@analysis("eda_refunds_by_product", "A", also=("C",))
def refunds_by_product(f: Funnel) -> DataFrame:
    r = f["order_item_refunds"].select("order_item_id").join(
        f["order_items"].select("order_item_id", "product_id"), "order_item_id", "left")
    return dq.value_counts(r, "product_id", "refunds")


@analysis("dq_refund_cap", "A", also=("C",))
def refund_cap(f: Funnel) -> DataFrame:
    """Refunds larger than the largest item price (expected 0); the maximum is a scalar subquery."""
    cap = f["order_items"].agg(F.max("price_usd")).scalar()
    flagged = f["order_item_refunds"].select(
        (~F.coalesce(F.col("refund_amount_usd") <= cap, F.lit(False))).alias("over_cap"))
    g = flagged.agg(F.count_if("over_cap").alias("violations"))
    return g.select(cap.cast(MONEY).alias("max_item_price"), "violations")


@analysis("dq_product_domain", "A", also=("C",))
def product_domain(f: Funnel) -> DataFrame:
    """The product ids of the order items against the expected set: found, missing, unexpected, and whether the sets are equal."""
    expected = [pid for pid, _ in PRODUCT_NAMES]
    # as text: a catalogue may use other keys than numbers
    known = F.coalesce(F.col("product_id").cast("string").isin(*[str(pid) for pid in expected]), F.lit(False))
    ids = f["order_items"].groupBy("product_id").agg(F.lit(1).alias("one"))
    g = ids.agg(F.count(F.lit(1)).alias("found_ids"), F.count_if(known).alias("known_ids"), F.count_if(~known).alias("unexpected_ids"))
    missing = F.lit(len(expected)) - F.col("known_ids")
    return g.select("found_ids", F.lit(len(expected)).cast("bigint").alias("expected_ids"), missing.cast("bigint").alias("missing_ids"),
                    "unexpected_ids", ((missing == 0) & (F.col("unexpected_ids") == 0)).alias("same_set"))


@analysis("eda_product_months_active", "A")
def product_months_active(f: Funnel) -> DataFrame:
    """Months from each product's launch to the dataset end (latest pageview)."""
    end = f["pageviews"].agg(F.max("created_at")).scalar()
    return f["products"].select("product_id", "product_name", month_diff(F.col("created_at"), end).alias("months_active"))


@analysis("dq_referential_integrity", "A", also=("B", "C"))
def referential_integrity(f: Funnel) -> DataFrame:
    """Orphan rows per foreign key (expected 0)."""
    return dq.union_all([
        dq.orphans(f["orders"], "website_session_id", f["sessions"], "website_session_id",
                   "orders_to_sessions", "orders"),
        dq.orphans(f["order_items"], "order_id", f["orders"], "order_id", "items_to_orders", "order_items"),
        dq.orphans(f["order_item_refunds"], "order_item_id", f["order_items"], "order_item_id",
                   "refunds_to_items", "order_item_refunds"),
        dq.orphans(f["pageviews"], "website_session_id", f["sessions"], "website_session_id",
                   "pageviews_to_sessions", "pageviews"),
        dq.orphans(f["order_items"], "product_id", f["products"], "product_id", "items_to_products", "order_items"),
    ])


@analysis("dq_cleaning_summary", "A")
def cleaning_summary(f: Funnel) -> DataFrame:
    """Per table: rows, columns before / after cleaning, added columns (computed, not typed in)."""
    frames = []
    for t in TABLES:
        raw, clean = f[f"raw_{t}"], f[t]
        added = [c for c in clean.columns if c not in raw.columns]
        frames.append(clean.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(t).alias("table_name"), "row_count",
            F.lit(len(raw.columns)).cast("bigint").alias("cols_before"),
            F.lit(len(clean.columns)).cast("bigint").alias("cols_after"),
            F.lit(", ".join(added) or "none").alias("added_columns")))
    return dq.union_all(frames)


@analysis("dq_load_counts", "A", also=("C",))
def load_counts_check(f: Funnel) -> DataFrame:
    """Write the six tables (Parquet, a fresh folder under ``spark.checkpoint.dir``), read them
    back and compare row counts: (table, expected, actual, status).

    The rows written are observed by the write itself. The folder is deleted once the counts
    of the copy are known, so only six pairs of numbers are left.
    """
    import uuid

    from clickpath.session import ensure_checkpoint_dir
    from clickpath.sources.ingest import load_counts, write_counted
    spark = f["sessions"].sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/clickpath-load-{uuid.uuid4().hex}"
    tables = {t: f[t] for t in TABLES}
    found = load_counts(spark, tables, path, expected=write_counted(tables, path))
    rows, schema = found.collect(), found.schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    return spark.createDataFrame(rows, schema)
