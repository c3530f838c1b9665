"""Ingest-time derivations: traffic channel, 'none' fill, page name, gross profit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpath.functions.metrics import MONEY
from clickpath.spec import FILL_VALUE

FILLED_COLUMNS = ("utm_source", "utm_campaign", "utm_content", "http_referer")


def traffic_channel_col(source="utm_source", referer="http_referer"):
    """First match: paid source -> its name; referer only -> organic; neither -> direct."""
    return (F.when(F.col(source).isNotNull(), F.col(source))
            .when(F.col(referer).isNotNull(), F.lit("organic"))
            .otherwise(F.lit("direct")))


def with_traffic_channel(sessions: DataFrame) -> DataFrame:
    """Add ``traffic_channel``. Must run before :func:`fill_none` (NULLs carry the signal)."""
    return sessions.withColumn("traffic_channel", traffic_channel_col())


def fill_none(sessions: DataFrame, columns=FILLED_COLUMNS) -> DataFrame:
    """Replace NULL in the UTM / referer columns with ``'none'``."""
    return sessions.fillna({c: FILL_VALUE for c in columns})


def clean_sessions(sessions: DataFrame) -> DataFrame:
    """Channel derivation, then fill: the order of the two steps matters."""
    return fill_none(with_traffic_channel(sessions))


def page_name_col(url="pageview_url"):
    """``'/a/b/' -> 'a'``, ``'/' -> 'home'``: strip slashes, first path part, '' -> home."""
    first = F.split(F.btrim(F.col(url), F.lit("/")), "/").getItem(0)
    return F.coalesce(F.nullif(first, F.lit("")), F.lit("home"))


def with_page_name(pageviews: DataFrame) -> DataFrame:
    return pageviews.withColumn("page_name", page_name_col())


def with_gross_profit(df: DataFrame) -> DataFrame:
    """``gross_profit = price_usd - cogs_usd`` (exact decimal)."""
    return df.withColumn("gross_profit", (F.col("price_usd") - F.col("cogs_usd")).cast(MONEY))
