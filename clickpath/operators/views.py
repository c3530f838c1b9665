"""The four session / user tables every analysis reads.

- :func:`funnel_flags`          one row per session: landing URL, product label, step flags
- :func:`product_page_sessions` sessions that saw a product page (label + 4 flags)
- :func:`landing_sessions`      every session with pageviews (landing label + 6 flags)
- :func:`session_funnel`        every session: attributes, flags, revenue
- :func:`user_attribution`      one row per user: first touch and converting touch

Each is one ``groupBy`` (flags are order-insensitive, so ``max`` collapses
them, and partial aggregation combines a hot session map-side) plus equi-joins
on the session or user key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickpath.functions.metrics import MONEY, flag, map_values
from clickpath.functions.packed import micros, packed_code, packed_id, packed_key
from clickpath.spec import DEFAULT_SPEC, FunnelSpec

SESSION = "website_session_id"
STEP_FLAGS = ("saw_product", "saw_cart", "saw_shipping", "saw_billing", "saw_thank_you")


def funnel_flags(pageviews: DataFrame, spec: FunnelSpec = DEFAULT_SPEC, key: str = SESSION,
                 ts: str = "created_at", pid: str = "website_pageview_id",
                 url: str = "pageview_url") -> DataFrame:
    """One row per ``key``: ``session_start`` (first view time), ``landing_pageview_id``
    (earliest view, pageview id breaks ties), ``Landing_Page`` (its label, NULL for a URL that
    is no known landing page), ``Page_Name`` (greatest product label seen) and 0/1 step flags.

    Labels are coded by their place in the spec and the earliest view is the minimum of one
    packed number, so every buffer has a fixed width and the views are hash-aggregated.
    :func:`landing_urls` fetches the landing URLs themselves, unknown ones included.
    """
    u = F.col(url)
    codes = len(spec.landing_pages) + 1
    landing_code = F.coalesce(map_values(u, [(page, F.lit(k + 1)) for k, page in enumerate(spec.landing_urls)]), F.lit(0))
    ranked = sorted(set(spec.product_labels), key=lambda label: label.encode())
    rank = map_values(u, [(page, F.lit(ranked.index(label))) for page, label in spec.product_pages])
    first = packed_key(micros(ts, pageviews.schema[ts].dataType), F.col(pid), landing_code, codes)
    picked = pageviews.groupBy(key).agg(
        F.min(ts).alias("session_start"),
        F.min(first).alias("_first"),
        F.max(rank).alias("_product"),
        F.max(flag(u == spec.products_url)).alias("saw_product"),
        F.max(flag(u.isin(*spec.product_urls))).alias("clicked_product"),
        F.max(flag(u == spec.cart_url)).alias("saw_cart"),
        F.max(flag(u == spec.shipping_url)).alias("saw_shipping"),
        F.max(flag(u.isin(*spec.billing_urls))).alias("saw_billing"),
        F.max(flag(u == spec.thank_you_url)).alias("saw_thank_you"),
    )
    return picked.select(
        key, "session_start", packed_id(F.col("_first"), codes).alias("landing_pageview_id"),
        map_values(packed_code(F.col("_first"), codes), [(k + 1, label) for k, (_, label) in enumerate(spec.landing_pages)]).alias("Landing_Page"),
        map_values("_product", list(enumerate(ranked))).alias("Page_Name"),
        "saw_product", "clicked_product", "saw_cart", "saw_shipping", "saw_billing", "saw_thank_you",
    )


def landing_urls(flags: DataFrame, pageviews: DataFrame, key: str = SESSION,
                 pid: str = "website_pageview_id", url: str = "pageview_url") -> DataFrame:
    """``(key, landing_url)`` of the sessions of :func:`funnel_flags`: any URL, known or not.

    A late fetch by (session, pageview id), so the URLs of all other views never leave the scan's side of the join.
    """
    first = flags.select(F.col(key).alias("_session"), F.col("landing_pageview_id").alias("_view"))
    same = F.col(key).eqNullSafe(F.col("_session")) & F.col(pid).eqNullSafe(F.col("_view"))
    return pageviews.select(key, pid, F.col(url).alias("landing_url")).join(first, same).select(key, "landing_url")


def product_page_sessions(pageviews: DataFrame, spec: FunnelSpec = DEFAULT_SPEC,
                          flags: DataFrame | None = None) -> DataFrame:
    """Sessions that reached a product page; one row each, under the greatest label."""
    f = flags if flags is not None else funnel_flags(pageviews, spec)
    return f.filter(F.col("Page_Name").isNotNull()).select(
        SESSION, "Page_Name", "saw_cart", "saw_shipping", "saw_billing", "saw_thank_you")


def landing_sessions(pageviews: DataFrame, spec: FunnelSpec = DEFAULT_SPEC,
                     flags: DataFrame | None = None) -> DataFrame:
    """Every session with pageviews: landing label (NULL for an unknown URL) and 6 flags."""
    f = flags if flags is not None else funnel_flags(pageviews, spec)
    return f.select(
        SESSION, "Landing_Page",
        "saw_product", "clicked_product", "saw_cart", "saw_shipping", "saw_billing", "saw_thank_you")


def session_revenue(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Item revenue per session, aggregated before it meets the session table."""
    return (orders.select("order_id", SESSION)
            .join(order_items.select("order_id", "price_usd"), "order_id")
            .groupBy(SESSION).agg(F.sum("price_usd").cast(MONEY).alias("session_revenue")))


def session_funnel(sessions: DataFrame, landing: DataFrame, orders: DataFrame,
                   order_items: DataFrame, extra_cols: tuple = ()) -> DataFrame:
    """Every session: UTM attributes, funnel flags (NULL without pageviews), revenue (NULL without order).

    ``extra_cols`` carries further session columns (e.g. ``created_at``) so a
    report never has to join the session table back.
    """
    s = sessions.select(SESSION, "utm_source", "utm_campaign", "utm_content", "device_type", "traffic_channel",
                        *extra_cols)
    m = landing.select(SESSION, *STEP_FLAGS)
    return (s.join(m, SESSION, "left")
            .join(session_revenue(orders, order_items), SESSION, "left"))


_TOUCH_ATTRS = ("utm_source", "utm_campaign", "utm_content", "device_type", "traffic_channel")


def user_attribution(sessions: DataFrame, orders: DataFrame, touch: str = "first_order",
                     with_times: bool = False) -> DataFrame:
    """One row per user: the first session's attributes and those of the converting session.

    ``touch='first_order'`` takes the session of the user's earliest order
    (the behaviour of the analysed reports); ``'last_order'`` the latest.
    Ties on time are broken by session id. Non-converters get NULL
    ``last_touch_*`` columns. Both picks are minima (maxima) of one packed
    (time, session id) number, hash-aggregated and combined map-side however
    heavy a user is; the attributes are fetched from the session afterwards.
    The joins are on the unique session id, so no user's rows meet in one task.
    """
    if touch not in ("first_order", "last_order"):
        raise ValueError(f"touch must be 'first_order' or 'last_order', not {touch!r}")
    s = sessions.select(SESSION, "created_at", "user_id", *_TOUCH_ATTRS)

    def order_key(df: DataFrame) -> Column:
        return packed_key(micros("created_at", df.schema["created_at"].dataType), F.col(SESSION))

    picked = s.groupBy("user_id").agg(F.min(order_key(s)).alias("_key"))
    picked = picked.select(F.col("user_id").alias("_user"), packed_id(F.col("_key")).alias("_session"))
    first = (s.join(picked, (F.col(SESSION) == F.col("_session")) & F.col("user_id").eqNullSafe(F.col("_user")))
             .select("user_id",
                     F.col(SESSION).alias("first_touch_website_session_id"),
                     F.col("created_at").alias("first_touch_created_at"),
                     *[F.col(a).alias(f"first_touch_{a}") for a in _TOUCH_ATTRS]))
    pick = F.min if touch == "first_order" else F.max
    converting = (orders.groupBy("user_id").agg(pick(order_key(orders)).alias("_key"))
                  .select(packed_id(F.col("_key")).alias(SESSION)))
    last = converting.join(s, SESSION).select(
        F.col("user_id").alias("l_user_id"),
        F.col(SESSION).alias("last_touch_website_session_id"),
        F.col("created_at").alias("last_touch_created_at"),
        *[F.col(a).alias(f"last_touch_{a}") for a in _TOUCH_ATTRS])
    times = ["first_touch_created_at", "last_touch_created_at"] if with_times else []
    return (first.join(last, first["user_id"] == last["l_user_id"], "left")
            .select("first_touch_website_session_id", "last_touch_website_session_id", "user_id",
                    *[f"first_touch_{a}" for a in _TOUCH_ATTRS],
                    *[f"last_touch_{a}" for a in _TOUCH_ATTRS], *times))
