"""Session settings and the shared scratch folder."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings this work is tuned for; all can be set on a running session.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Long rule chains make methods the JVM would not compile; above this size
    # (bytes) Spark generates code per operator instead of per stage.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

CHECKPOINT_DIR = "spark.checkpoint.dir"


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session's settings.

    Only a local session without that setting gets a temporary folder of its own, which
    is then kept in the setting; on a cluster it would be a folder of one machine.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_DIR} has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="reportweave-")
        spark.conf.set(CHECKPOINT_DIR, base)
    return base.rstrip("/")


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows as Parquet files at ``path``, below the shared folder; :func:`remove` takes them away."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


# Seconds in which the JVM drops what Python has dropped; it takes longer only if that is much.
DROPPED_S = 0.3


def let_go(spark: SparkSession) -> None:
    """Have Spark remove the files of shuffles and checkpoints that nothing uses any more.

    It does so after the driver's JVM has collected garbage, which a driver with little to do may put off to the end.
    What Python drops is dropped in the JVM by a thread that looks for it every tenth of a second, and listeners hold the
    last query until another one ends; without both, files of the step before would mostly stay until the next call.
    """
    gc.collect()
    spark.range(1).collect()
    time.sleep(DROPPED_S)
    spark.sparkContext._jvm.System.gc()


# Rows of one task before costly expressions.
ROWS_PER_TASK = 50_000


def spread(df: DataFrame, rows: int = ROWS_PER_TASK) -> DataFrame:
    """Deal a table out to tasks of ``rows`` rows at most before costly expressions.

    Splits are made by bytes and row groups, so a table that packs well would be computed by few long tasks.
    The count comes from the footers of Parquet files.  Rows are dealt in turn, so that keys that repeat or are null
    make no task larger.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks)
