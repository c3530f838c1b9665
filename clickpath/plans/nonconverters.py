"""Users who never ordered: size, channel and device mix, sessions, last page, checkout drop, recency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpath.functions.metrics import avg_2dp_decimal, day_diff, pct
from clickpath.operators.funnel import last_event, rate_by, share_of_total
from clickpath.plans.context import Funnel
from clickpath.plans.registry import analysis

def _not_converted():
    return F.col("last_touch_website_session_id").isNull()


def _non_converters(f: Funnel) -> DataFrame:
    return f.attribution.filter(_not_converted())


def _non_converter_sessions(f: Funnel) -> DataFrame:
    """Sessions of non-converting users: ``sessions ⋉ non-converters`` on user id.

    Every attribution user comes from ``sessions``, so this equals
    "non-converters ⟕ sessions" minus the unmatched rows, with the large
    table on the left of a semi join, where adaptive execution can split a
    user that owns a large share of all sessions.
    """
    users = _non_converters(f).select("user_id")
    return f["sessions"].select("user_id", "website_session_id").join(users, "user_id", "left_semi")


def _null_user_non_converters(f: Funnel) -> DataFrame:
    """The attribution row of NULL-id users, if it is a non-converter (it matches no session)."""
    return _non_converters(f).filter(F.col("user_id").isNull()).select("user_id")


@analysis("q07_1_non_converters", "A", also=("B",))
def non_converters(f: Funnel) -> DataFrame:
    """All users, non-converters, non-converter %."""
    g = f.attribution.agg(F.count("user_id").alias("Total_Users"),
                          F.count(F.when(_not_converted(), F.col("user_id"))).alias("Non_Converters"))
    return g.select("Total_Users", "Non_Converters", pct("Non_Converters", "Total_Users").alias("Non_Converter_Pct"))


def _non_conversion_by(f: Funnel, key: str) -> DataFrame:
    # users are counted by their (non-NULL) first-touch channel, as coded
    return rate_by(f.attribution, [key], _not_converted(), "All_Users", "Non_Converting_Users",
                   "Non_Conversion_Rate_Pct", total=F.col("first_touch_traffic_channel"))


@analysis("q07_2_by_channel", "A", also=("B",), order=('-Non_Converting_Users',))
def by_channel(f: Funnel) -> DataFrame:
    """First-touch channel: users, non-converters, non-conversion %."""
    return _non_conversion_by(f, "first_touch_traffic_channel")


@analysis("q07_3_by_device", "A", also=("B",), order=('-Non_Conversion_Rate_Pct',))
def by_device(f: Funnel) -> DataFrame:
    """First-touch device: users, non-converters, non-conversion % (counting non-NULL channels)."""
    return _non_conversion_by(f, "first_touch_device_type")


def _non_converter_session_counts(f: Funnel) -> DataFrame:
    """Sessions per non-converting user (sessions ⟕ attribution, kept where no converting touch).

    Sessions are counted per session user first, so the join runs at user
    grain; users without an attribution row fall into one NULL-user group.
    """
    per_user = f["sessions"].groupBy("user_id").agg(F.count("website_session_id").alias("c"))
    a = f.attribution.select(F.col("user_id").alias("u_user_id"), "last_touch_website_session_id")
    rows = per_user.join(a, per_user["user_id"] == a["u_user_id"], "left").filter(_not_converted())
    return rows.groupBy(F.col("u_user_id").alias("user_id")).agg(F.sum("c").alias("session_count"))


@analysis("q07_4_avg_sessions", "A", also=("B",))
def avg_sessions_non_converters(f: Funnel) -> DataFrame:
    """Mean sessions of non-converting users, DECIMAL(10,2)."""
    g = _non_converter_session_counts(f).agg(F.sum("session_count").alias("t"), F.count(F.lit(1)).alias("n"))
    return g.select(avg_2dp_decimal("t", "n").alias("Avg_Sessions_Before_Drop_Off"))


@analysis("q07_4b_sessions_dist", "A", also=("B",), order=('session_count',))
def sessions_dist_non_converters(f: Funnel) -> DataFrame:
    g = _non_converter_session_counts(f).groupBy("session_count").agg(F.count("user_id").alias("User_Count"))
    return share_of_total(g, "User_Count", "Pct")


@analysis("q07_5_last_page", "B", also=("A",), order=('-User_Count',))
def last_page(f: Funnel) -> DataFrame:
    """Page name of the last pageview of each non-converter's last session: users.

    "Last" keeps ties, as an equality join against the maximum does: a user
    with two sessions at the latest time, or a session with two pageviews at
    its latest time, is counted under each. Maxima are aggregates joined back
    on (key, time), so a heavy user or session is never one task.
    """
    last_page_name = last_event(f["pageviews"], "website_session_id", keep=("page_name",)).select(
        "website_session_id", "page_name")
    last_session = last_event(f["sessions"], "user_id", keep=("website_session_id",)).select(
        "user_id", "website_session_id")
    rows = (_non_converters(f).select("user_id")
            .join(last_session, "user_id", "left")
            .join(last_page_name, "website_session_id", "left"))
    return rows.groupBy("page_name").agg(F.count("user_id").alias("User_Count"))


@analysis("q07_6_checkout_drop", "A", also=("B",))
def checkout_drop(f: Funnel) -> DataFrame:
    """Non-converters; their sessions that reached cart, and that stopped at cart, shipping or billing.

    Counts are sessions, as coded: a user with several such sessions is
    counted once per session.
    """
    m = f.landing.select("website_session_id", "saw_cart", "saw_shipping", "saw_billing", "saw_thank_you")
    rows = _non_converter_sessions(f).join(m, "website_session_id", "left")
    c = F.col
    return rows.agg(
        F.count_distinct("user_id").alias("Total_Non_Converters"),
        F.count(F.when(c("saw_cart") == 1, c("user_id"))).alias("Reached_Cart"),
        F.count(F.when((c("saw_cart") == 1) & (c("saw_shipping") == 0), c("user_id"))).alias("Dropped_At_Cart"),
        F.count(F.when((c("saw_shipping") == 1) & (c("saw_billing") == 0), c("user_id"))).alias("Dropped_At_Shipping"),
        F.count(F.when((c("saw_billing") == 1) & (c("saw_thank_you") == 0), c("user_id"))).alias("Dropped_At_Billing"),
    )


def recency_bucket(days_col: str, spec) -> F.Column:
    """Inclusive day ranges -> label; anything else (NULL, negative, beyond the last range) -> ELSE label."""
    d = F.col(days_col)
    expr = None
    for low, high, label in spec.recency_buckets:
        cond = d.between(low, high)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(spec.recency_else)


def non_converter_last_visit(f: Funnel) -> DataFrame:
    """Per non-converting user: time of the last pageview over all their sessions.

    Pageviews are reduced to one last time per session before they meet the
    users; users are matched through a semi join with sessions on the left.
    """
    per_session = f["pageviews"].groupBy("website_session_id").agg(F.max("created_at").alias("last_view"))
    rows = _non_converter_sessions(f).join(per_session, "website_session_id", "left")
    last = rows.groupBy("user_id").agg(F.max("last_view").alias("Last_Visit"))
    nulls = _null_user_non_converters(f).select("user_id", F.lit(None).cast("timestamp_ntz").alias("Last_Visit"))
    return last.unionByName(nulls)


@analysis("q07_7_recency", "B", also=("A",), order=('Avg_Days_Since_Visit',))
def recency(f: Funnel) -> DataFrame:
    """Non-converters by days since their last pageview (relative to the latest pageview overall).

    Pageviews are reduced to a last time per session before they meet the
    users; the dataset end is a scalar subquery, evaluated once.
    """
    last_visit = non_converter_last_visit(f)
    end = f["pageviews"].agg(F.max("created_at")).scalar()
    last_visit = last_visit.withColumn("Days_Since_Visit", day_diff(F.col("Last_Visit"), end))
    g = (last_visit.withColumn("Recency_Bucket", recency_bucket("Days_Since_Visit", f.spec))
         .withColumn("_d", F.when(F.col("user_id").isNotNull(), F.col("Days_Since_Visit")))
         .groupBy("Recency_Bucket").agg(F.sum("_d").alias("t"), F.count("_d").alias("n"),
                                        F.count("user_id").alias("User_Count")))
    # AVG of an integer column truncates toward zero.
    return g.select("Recency_Bucket", F.expr("t div nullif(n, 0)").alias("Avg_Days_Since_Visit"), "User_Count")
