"""Streams: bounded intake of report files, structuring of answers, running counts.

Every stream keeps its progress in a checkpoint folder and can be stopped or
killed at any time.  Batches are written under their own number, so that a batch
that runs again replaces its earlier output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import file_name
from ..plans.structure import structure
from ..sources.readers import REPORT_FILE_SCHEMA, RESPONSES_SCHEMA

BATCH = "batch"
STATE_PARTS = "spark.sql.shuffle.partitions"


def _batch_writer(sink: str, step: Callable[[DataFrame], DataFrame] | None) -> Callable:
    def write(batch: DataFrame, number: int) -> None:
        rows = step(batch) if step else batch
        rows.write.mode("overwrite").parquet(f"{sink}/{BATCH}={number}")

    return write


def read_batches(spark: SparkSession, sink: str) -> DataFrame:
    """Everything a stream has written so far, without the batch number."""
    return spark.read.option("basePath", sink).parquet(f"{sink}/{BATCH}=*").drop(BATCH)


def report_files(spark: SparkSession, path: str, every: int, glob: str | None = None) -> DataFrame:
    """The files of a folder as a stream, ``every`` files per batch."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema(REPORT_FILE_SCHEMA)
        .option("maxFilesPerTrigger", every)
    )
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(file_name(F.col("path")).alias("report"), "*")


def stream_reports(
    spark: SparkSession,
    path: str,
    sink: str,
    checkpoint: str,
    every: int = 20,
    step: Callable[[DataFrame], DataFrame] | None = None,
    glob: str | None = None,
) -> StreamingQuery:
    """Take in the files of a folder, ``every`` files per batch, until all are done.

    ``step`` turns a batch of ``(report, path, modificationTime, length, content)``
    into what is written, for instance the answers of a model.
    """
    files = report_files(spark, path, every, glob)
    return (
        files.writeStream.foreachBatch(_batch_writer(sink, step))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_response_stream(spark: SparkSession, path: str, every: int = 20) -> DataFrame:
    """Parquet answers as a stream, ``every`` files per batch, dealt over all cores however few the files."""
    reader = spark.readStream.schema(RESPONSES_SCHEMA).option("maxFilesPerTrigger", every)
    return reader.parquet(path).repartition(spark.sparkContext.defaultParallelism)


def stream_structured(responses: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Structure a stream of answers; stateless, appended to Parquet."""
    return (
        structure(responses).writeStream.format("parquet")
        .outputMode("append")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_counts(rows: DataFrame, column: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Running counts of a category; each batch writes the complete table of counts.

    The state has a part per core at most: each part is committed in each batch, and counts are few rows.
    """
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count(column).alias("n")).where("n > 0")
    writer = (
        counts.writeStream.outputMode("complete")
        .foreachBatch(_batch_writer(sink, None))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    # A query keeps the setting that it was first started with.
    spark = rows.sparkSession
    parts = spark.conf.get(STATE_PARTS)
    spark.conf.set(STATE_PARTS, str(min(int(parts), spark.sparkContext.defaultParallelism)))
    try:
        return writer.start()
    finally:
        spark.conf.set(STATE_PARTS, parts)


def latest_counts(spark: SparkSession, sink: str) -> DataFrame:
    """The counts after the last batch."""
    everything = spark.read.option("basePath", sink).parquet(f"{sink}/{BATCH}=*")
    last = everything.agg(F.max(BATCH)).scalar()
    return everything.where(F.col(BATCH) == last).drop(BATCH)
