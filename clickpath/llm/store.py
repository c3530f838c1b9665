"""Cutting lineage: tables written below the session's shared checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import clickpath
from clickpath.session import ensure_checkpoint_dir

#: Stands in for a null id: such rows count as coming after all others.
NO_ID = (1 << 63) - 1


BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per session, so that their Python workers can import it.

    Python workers get batches of at most ``BATCH_ROWS`` rows, which bounds what a worker holds of long texts.
    """
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if not getattr(sc, "_clickpath_shipped", False):
        home = os.path.dirname(os.path.abspath(clickpath.__file__))
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="clickpath-zip-"), "clickpath"), "zip", os.path.dirname(home), os.path.basename(home))
        sc.addPyFile(made)
        sc._clickpath_shipped = True


#: Spark removes a query's shuffle files at its end if this is set.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet below ``spark.checkpoint.dir`` and read it back.

    The written table outlives lost executors; every reader starts from it
    instead of recomputing what lies above, so the shuffle files of the write
    are not needed again and go at its end.
    """
    ship(spark)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/clickpath-llm/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, id, text)`` of ``docs``: ``id`` is the id, or :data:`NO_ID` for null; null texts become empty.

    Other columns are left behind here, so their names cannot clash with those
    that the operators add.
    """
    ship(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
