"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "clickpath") -> SparkSession:
    """Return the active session, the spark-submit session, or a local one for tests and benches.

    Under spark-submit the master and settings come from the submission (see
    :data:`SCALE_CONF`); the settings below apply to local runs only.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    if master is None and os.environ.get("PYSPARK_GATEWAY_PORT"):
        # launched by spark-submit (the JVM started this Python process): the cluster's
        # master and settings apply as given
        spark = SparkSession.builder.appName(app_name).getOrCreate()
        ensure_checkpoint_dir(spark)
        return spark
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.ui.retainedExecutions", "20")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; create a scratch one only if unset.

    A cluster names a shared folder there (HDFS / object store) so that a cut
    lineage survives the loss of any executor. Only local runs and tests,
    where the setting is absent, get a fresh folder under the system temp dir.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: no SparkContext on the client
        sc = None
    if conf_dir:
        if sc is not None and sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    if sc is None or not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local_dir = tempfile.mkdtemp(prefix="clickpath-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local_dir)
    if sc is not None:
        sc.setCheckpointDir(local_dir)
    return local_dir


# Cluster settings for a large input; a job is submitted with these (spark-submit --conf ...).
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def shuffle_partitions_for(input_bytes: int, target_bytes: int = 256 * 1024 ** 2,
                           minimum: int = 200) -> int:
    """Initial shuffle partitions for ``input_bytes`` of input: about ``target_bytes`` each.

    Adaptive execution then coalesces small partitions and splits skewed ones;
    the initial number only has to be large enough that no partition spills
    badly before AQE sees the real sizes (100 TB -> about 400k).
    """
    n = -(-int(input_bytes) // int(target_bytes))
    return max(minimum, n)


def configure_for_scale(spark: SparkSession, input_bytes: int) -> dict:
    """Apply :data:`SCALE_CONF` and a shuffle partition count sized from the input."""
    conf = dict(SCALE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions_for(input_bytes))
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf
