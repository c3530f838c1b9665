"""Reading the driver's Parquet tables and the six funnel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

FUNNEL_TABLES = ("sessions", "pageviews", "orders", "order_items", "order_item_refunds", "products")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy Parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_funnel_tables(spark: SparkSession, path: str, fmt: str = "parquet") -> dict:
    """Load the six funnel tables written by :func:`clickpath.sources.ingest.write_tables`."""
    reader = spark.read.format(fmt)
    return {name: reader.load(f"{path.rstrip('/')}/{name}") for name in FUNNEL_TABLES}
