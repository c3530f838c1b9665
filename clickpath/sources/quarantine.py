"""CSV loads that set bad rows aside, check what they wrote, and only then publish it.

Every row of an extract is either good (all columns parse) or rejected; nothing
is dropped. One pass reads, judges and writes a staged copy, and the counts for
the audit are observed in that same pass. Rejected rows keep the file they came
from, the row itself and a reason for each bad column. A load that rejects more
than its budget, or fails a check, publishes nothing: the table that was there
stays as it is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickpath.sources.ingest import CSV_FILES, NULL_MARKERS, SCHEMAS, string_schema

_CORRUPT = "_corrupt_record"
_TIMESTAMP = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"


class LoadRejected(Exception):
    """A load that published nothing; ``staged`` still holds its rows for inspection."""

    def __init__(self, message: str, staged: str):
        super().__init__(message)
        self.staged = staged


@dataclass
class Load:
    """What one load did: rows read, rows set aside, NULLs by column, and where the tables are."""

    table: str
    rows: int
    rejected: int
    nulls: dict[str, int]
    path: str
    quarantine: str


def _parsed(name: str, dtype: str) -> tuple[Column, Column]:
    """The typed column, NULL where it does not parse, and whether its text is one that does."""
    text = F.when(F.col(name).isin(*NULL_MARKERS), F.lit(None)).otherwise(F.col(name))
    if dtype == "timestamp":
        value = F.when(text.rlike(_TIMESTAMP), text).try_cast("timestamp_ntz")
    else:
        value = text.try_cast(dtype)
    return value, text.isNull() | value.isNotNull()


def judged_rows(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Every row of a CSV extract: ``rejected``, its typed columns as ``good``, and ``file``, ``row``, ``reasons``.

    A row with too few or too many fields is rejected as a whole. A header
    with other names or another order is still an error: then every column
    would be read as the wrong one.
    """
    schema = string_schema(table).add(_CORRUPT, T.StringType())
    raw = (spark.read.option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", _CORRUPT).schema(schema).csv(path))
    good, reasons = [], [F.when(F.col(_CORRUPT).isNotNull(), F.lit("the number of fields differs from the header"))]
    for name, dtype in SCHEMAS[table]:
        value, parses = _parsed(name, dtype)
        good.append(value.alias(name))
        reasons.append(F.when(F.col(_CORRUPT).isNull() & ~parses, F.concat(F.lit(f"{name}: no {dtype}: "), F.col(name))))
    written = F.to_csv(F.struct(*[F.col(name) for name, _ in SCHEMAS[table]]))
    rows = raw.select(F.struct(*good).alias("good"), F.filter(F.array(*reasons), lambda r: r.isNotNull()).alias("reasons"),
                      F.coalesce(_CORRUPT, written).alias("row"), F.col("_metadata.file_path").alias("file"))
    bad = F.size("reasons") > 0
    return rows.select(bad.alias("rejected"), F.when(~bad, F.col("good")).alias("good"),
                       *[F.when(bad, F.col(c)).alias(c) for c in ("file", "row", "reasons")])


def load_table(spark: SparkSession, path: str, table: str, out: str, max_rejected: float = 0.01,
               checks: dict[str, Callable[[DataFrame], bool]] | None = None) -> Load:
    """Load one extract into ``out/<table>`` and its rejected rows into ``out/<table>_rejected``.

    ``max_rejected`` is the share of rows that may be rejected; ``checks`` are
    conditions by name on the staged good rows. If one is not met, :class:`LoadRejected` is raised and the
    published table is untouched.
    """
    out = out.rstrip("/")
    staged = f"{out}/_staged/{table}-{uuid.uuid4().hex}"
    seen = Observation(f"load {table}")
    names = [name for name, _ in SCHEMAS[table]]
    rows = judged_rows(spark, path, table).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("rejected")).alias("rejected"),
        *[F.count_if(~F.col("rejected") & F.col(f"good.{n}").isNull()).alias(f"null_{n}") for n in names])
    rows.write.partitionBy("rejected").parquet(staged)
    counts = seen.get
    total, rejected = counts["rows"], counts["rejected"]
    if rejected > max_rejected * total:
        raise LoadRejected(f"{table}: {rejected} of {total} rows rejected, the budget is {max_rejected:.2%}", staged)
    back = spark.read.schema(rows.schema).parquet(staged)
    good = back.where(~F.col("rejected")).select("good.*")
    if good.count() != total - rejected:
        raise LoadRejected(f"{table}: the staged copy does not hold the rows that were read", staged)
    for name, check in (checks or {}).items():
        if not check(good):
            raise LoadRejected(f"{table}: check {name!r} failed", staged)
    load = Load(table, total, rejected, {n: counts[f"null_{n}"] for n in names}, f"{out}/{table}", f"{out}/{table}_rejected")
    bad = back.where("rejected").select(F.lit(table).alias("table_name"), "file", "row", "reasons")
    for df, target in ((bad, load.quarantine), (good, load.path)):
        ready = f"{staged}-{target.rsplit('/', 1)[1]}"
        df.write.parquet(ready)
        swap(spark, ready, target)
    _files(spark, staged)[0].delete(_files(spark, staged)[1], True)
    return load


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def swap(spark: SparkSession, ready: str, target: str) -> None:
    """Put the folder ``ready`` in the place of ``target`` by renames; the old one comes back if that fails.

    On a file system whose renames are atomic no reader sees half a table. An
    object store needs a table format for that.
    """
    fs, new = _files(spark, ready)
    _, place = _files(spark, target)
    _, old = _files(spark, f"{target}.old-{uuid.uuid4().hex}")
    had = fs.exists(place)
    if had and not fs.rename(place, old):
        raise OSError(f"cannot move {target} away")
    if not fs.rename(new, place):
        if had:
            fs.rename(old, place)
        raise OSError(f"cannot move {ready} to {target}")
    if had:
        fs.delete(old, True)


def load_all(spark: SparkSession, data_path: str, out: str, files: dict = CSV_FILES, **options) -> dict[str, Load]:
    """All extracts of a folder, one :func:`load_table` each."""
    return {t: load_table(spark, f"{data_path.rstrip('/')}/{name}", t, out, **options) for t, name in files.items()}
