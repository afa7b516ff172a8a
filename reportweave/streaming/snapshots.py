"""Snapshots of a running stream, and the latest answer to each report.

A batch becomes visible by a row in the table of commits, written after the batch itself: what was read, what was
written, and where.  Every try of a batch has a folder of its own, so nothing that a reader may have open
is ever replaced, and a batch that was torn has no row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .intake import BATCH, report_files

COMMITS_SCHEMA = "batch long, folder string, files long, n_rows long"
COMMITS = "commits"
# Where the state is: on the disk of the executors, with so many MB of each for what is in use.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


def stream_snapshots(
    spark: SparkSession,
    path: str,
    sink: str,
    checkpoint: str,
    every: int = 20,
    step: Callable[[DataFrame], DataFrame] | None = None,
    glob: str | None = None,
) -> StreamingQuery:
    """Take in the files of a folder, ``every`` files per batch; each batch is a snapshot of all files so far."""

    def write(batch: DataFrame, number: int) -> None:
        files, rows, folder = Observation(), Observation(), f"{BATCH}-{number}-{uuid.uuid4().hex}"
        read = batch.observe(files, F.count(F.lit(1)).alias("n"))
        made = (step(read) if step else read).observe(rows, F.count(F.lit(1)).alias("n"))
        made.write.parquet(f"{sink}/data/{folder}")
        commit = [(number, folder, files.get["n"], rows.get["n"])]
        spark.createDataFrame(commit, COMMITS_SCHEMA).coalesce(1).write.mode("append").parquet(f"{sink}/{COMMITS}")

    return (
        report_files(spark, path, every, glob).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def snapshots(spark: SparkSession, sink: str) -> DataFrame:
    """``(batch, folder, files, n_rows, total_files, total_rows)``, one row per batch that is complete.

    A batch that ran twice has two complete tries of the same rows, of which one counts.  Batches after one that is
    missing do not count.
    """
    tries = spark.read.schema(COMMITS_SCHEMA).parquet(f"{sink}/{COMMITS}")
    one = tries.groupBy(BATCH).agg(F.min(F.struct("folder", "files", "n_rows")).alias("c")).select(BATCH, "c.*")
    # One row per batch of a stream.
    so_far = W.orderBy(BATCH)
    return one.select(
        "*", F.sum("files").over(so_far).alias("total_files"), F.sum("n_rows").over(so_far).alias("total_rows"),
        (F.row_number().over(so_far) - 1).alias("place"),
    ).where(F.col("place") == F.col(BATCH)).drop("place")


def read_snapshot(spark: SparkSession, sink: str, total_files: int | None = None) -> DataFrame:
    """The rows of the newest snapshot, or of the newest one of ``total_files`` files at most.

    The folders are chosen when it is called, so batches that come in later do not show.
    """
    known = snapshots(spark, sink)
    if total_files is not None:
        known = known.where(F.col("total_files") <= total_files)
    folders = [f"{sink}/data/{row.folder}" for row in known.orderBy(BATCH).collect()]
    if not folders:
        raise ValueError("there is no snapshot yet")
    return spark.read.parquet(*folders)


def stream_latest(answers: DataFrame, sink: str, checkpoint: str, order: str = "answered_at") -> StreamingQuery:
    """Keep the last answer to each report of a stream ``(report, response, <order>)``.

    The state holds one answer per report, on disk, as it grows with the reports.  An answer that comes twice, or after a later one, changes nothing, so
    it does not matter in which order and how often answers are delivered.  Of answers of the same time the
    greatest text counts.  A batch writes the reports that have changed.
    """
    last = answers.groupBy("report").agg(F.max(F.struct(order, "response")).alias("last"))

    def write(batch: DataFrame, number: int) -> None:
        batch.select("report", "last.*").write.mode("overwrite").parquet(f"{sink}/{BATCH}={number}")

    writer = (
        last.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    # A query keeps the settings that it was first started with.
    conf = answers.sparkSession.conf
    before = {name: conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        conf.set(name, value)
    try:
        return writer.start()
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def read_latest(spark: SparkSession, sink: str, order: str = "answered_at") -> DataFrame:
    """``(report, response, <order>)``: one row per report, its last answer."""
    rows = spark.read.option("basePath", sink).parquet(f"{sink}/{BATCH}=*")
    last = rows.groupBy("report").agg(F.max(F.struct(order, "response")).alias("last"))
    return last.select("report", "last.response", f"last.{order}")
