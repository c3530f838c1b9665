"""CSV ingest of the six raw tables, sinks, and the load-count check.

CSV is read with an explicit all-string schema, NULL markers are normalised
(pandas treats a whole list of strings as missing; Spark's reader takes one),
and values are then cast to the typed schema with ANSI casts, so a malformed
value fails the job instead of silently becoming NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickpath.operators.cleaning import clean_sessions, with_gross_profit, with_page_name

# File names of the raw extracts, by table.
CSV_FILES = {
    "sessions": "website_sessions.csv",
    "pageviews": "website_pageviews.csv",
    "orders": "orders.csv",
    "order_items": "order_items.csv",
    "order_item_refunds": "order_item_refunds.csv",
    "products": "products.csv",
}

# The strings pandas' CSV reader treats as missing by default.
NULL_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"

_TS = "timestamp"
SCHEMAS: dict[str, list[tuple[str, str]]] = {
    "sessions": [("website_session_id", "bigint"), ("created_at", _TS), ("user_id", "bigint"),
                 ("is_repeat_session", "int"), ("utm_source", "string"), ("utm_campaign", "string"),
                 ("utm_content", "string"), ("device_type", "string"), ("http_referer", "string")],
    "pageviews": [("website_pageview_id", "bigint"), ("created_at", _TS), ("website_session_id", "bigint"),
                  ("pageview_url", "string")],
    "orders": [("order_id", "bigint"), ("created_at", _TS), ("website_session_id", "bigint"), ("user_id", "bigint"),
               ("primary_product_id", "int"), ("items_purchased", "int"), ("price_usd", "decimal(18,2)"),
               ("cogs_usd", "decimal(18,2)")],
    "order_items": [("order_item_id", "bigint"), ("created_at", _TS), ("order_id", "bigint"), ("product_id", "int"),
                    ("is_primary_item", "int"), ("price_usd", "decimal(18,2)"), ("cogs_usd", "decimal(18,2)")],
    "order_item_refunds": [("order_item_refund_id", "bigint"), ("created_at", _TS), ("order_item_id", "bigint"),
                           ("order_id", "bigint"), ("refund_amount_usd", "decimal(18,2)")],
    "products": [("product_id", "int"), ("created_at", _TS), ("product_name", "string")],
}


def string_schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType(), True) for name, _ in SCHEMAS[table]])


def normalise_nulls(df: DataFrame, markers=NULL_MARKERS) -> DataFrame:
    """Every value that is one of the markers, blanks included, becomes NULL, in every string column."""
    return df.select(*[F.when(F.col(c).isin(*markers), F.lit(None)).otherwise(F.col(c)).alias(c)
                       for c in df.columns])


def typed(df: DataFrame, table: str) -> DataFrame:
    """Cast to the table's schema; ``created_at`` is parsed with an explicit format."""
    cols = []
    for name, dtype in SCHEMAS[table]:
        c = F.col(name)
        if dtype == _TS:
            cols.append(F.to_timestamp_ntz(c, F.lit(TIMESTAMP_FORMAT)).alias(name))
        else:
            cols.append(c.cast(dtype).alias(name))
    return df.select(*cols)


def read_csv_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    # enforceSchema off: a header whose names are in another order is an error instead of swapped columns
    raw = (spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
           .schema(string_schema(table)).csv(path))
    return typed(normalise_nulls(raw), table)


def load_csv_tables(spark: SparkSession, data_path: str, files: dict = CSV_FILES) -> dict:
    """The six raw tables from a folder of CSV extracts (lazy; one scan per table per job)."""
    base = data_path.rstrip("/")
    return {t: read_csv_table(spark, f"{base}/{name}", t) for t, name in files.items()}


CASE_FOLDED = {"sessions": ("utm_source", "utm_campaign", "utm_content", "device_type", "http_referer"),
               "pageviews": ("pageview_url",)}


def fold_case(df: DataFrame, cols) -> DataFrame:
    """``lower(trim(x))`` on the given text columns: string equality then behaves like a
    case-insensitive, trailing-space-insensitive collation, decided once at ingest."""
    return df.select(*[F.lower(F.trim(F.col(c))).alias(c) if c in cols else F.col(c) for c in df.columns])


def clean_tables(raw: dict, case_insensitive: bool = False) -> dict:
    """Ingest derivations: channel then 'none' fill on sessions, page name, gross profit.

    ``case_insensitive=True`` folds URLs and UTM values first (binary comparison otherwise).
    """
    if case_insensitive:
        raw = {t: fold_case(df, CASE_FOLDED[t]) if t in CASE_FOLDED else df for t, df in raw.items()}
    out = dict(raw)
    out["sessions"] = clean_sessions(raw["sessions"])
    out["pageviews"] = with_page_name(raw["pageviews"])
    out["orders"] = with_gross_profit(raw["orders"])
    out["order_items"] = with_gross_profit(raw["order_items"])
    return out


# ---------------------------------------------------------------------------
# Sinks
# ---------------------------------------------------------------------------

def write_tables(tables: dict, path: str, fmt: str = "parquet", mode: str = "overwrite",
                 partition_by: dict | None = None, names=None) -> dict[str, str]:
    """Write each table under ``path/<name>``; optional partition columns per table.

    ``mode='overwrite'`` replaces a table; with
    ``spark.sql.sources.partitionOverwriteMode=dynamic`` only the partitions
    present in the new data are replaced (an incremental month reload).
    """
    out = {}
    for name in names or tables:
        w = tables[name].write.mode(mode).format(fmt)
        if fmt == "csv":
            w = w.option("header", True)
        if partition_by and name in partition_by:
            w = w.partitionBy(*partition_by[name])
        target = f"{path.rstrip('/')}/{name}"
        w.save(target)
        out[name] = target
    return out


def export_csv(tables: dict, path: str, mode: str = "overwrite") -> dict[str, str]:
    """Cleaned tables as CSV with a header, one folder per table (``<name>_clean``)."""
    renamed = {f"{k}_clean": v for k, v in tables.items()}
    return write_tables(renamed, path, fmt="csv", mode=mode)


def save_as_tables(tables: dict, database: str | None = None, mode: str = "overwrite", types: dict | None = None) -> list[str]:
    """Catalog tables (``saveAsTable``); ``mode='append'`` for incremental loads.

    ``types`` gives column types by table and column (``{"orders": {"price_usd": "decimal(10,2)"}}``)
    in place of those of the data; a value that does not fit is an error, not a NULL.
    """
    names = []
    for name, df in tables.items():
        full = f"{database}.{name}" if database else name
        wanted = (types or {}).get(name, {})
        unknown = set(wanted) - set(df.columns)
        if unknown:
            raise ValueError(f"{name} has no columns {sorted(unknown)}")
        df = df.select(*[F.col(c).cast(wanted[c]).alias(c) if c in wanted else F.col(c) for c in df.columns])
        df.write.mode(mode).saveAsTable(full)
        names.append(full)
    return names


def write_counted(tables: dict, path: str, fmt: str = "parquet", mode: str = "overwrite") -> dict[str, int]:
    """:func:`write_tables`, with the rows of each table observed by the pass that writes it.

    The metric sits in the writing stage, whose tasks are committed once each, so retries do not count twice.
    """
    counts = {}
    for name, df in tables.items():
        seen = Observation(f"write {name}")
        write_tables({name: df.observe(seen, F.count(F.lit(1)).alias("rows"))}, path, fmt, mode)
        counts[name] = seen.get["rows"]
    return counts


def load_counts(spark: SparkSession, tables: dict, path: str, fmt: str = "parquet", expected: dict | None = None) -> DataFrame:
    """Row counts of each source table vs the table read back from ``path/<name>``.

    One DataFrame: (table_name, expected, actual, status); every count is a
    distributed aggregate. With ``expected`` (of :func:`write_counted`) the
    sources are not counted again.
    """
    frames = []
    for name, df in tables.items():
        back = spark.read.format(fmt).load(f"{path.rstrip('/')}/{name}")
        a = back.agg(F.count(F.lit(1)).alias("actual"))
        if expected is not None:
            frames.append(a.select(F.lit(name).alias("table_name"), F.lit(expected[name]).cast("bigint").alias("expected"), "actual"))
            continue
        e = df.agg(F.count(F.lit(1)).alias("expected"))
        frames.append(e.select(F.lit(name).alias("table_name"), "expected", a.scalar().alias("actual")))
    out = reduce(lambda x, y: x.unionByName(y), frames)
    return out.withColumn("status", F.when(F.col("expected") == F.col("actual"), "OK").otherwise("MISMATCH"))
