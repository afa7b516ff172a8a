"""What several operators need: stored intermediate results, joins with few ids, held-out rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reportweave.session import shared_folder

# Ids that may be broadcast: about 16 MB; more are joined by a shuffle.
BROADCAST_IDS = 500_000

# Ids given to rows that have none start here, above all usual ones.
FIRST_OWN_ID = 1 << 62

ASCII_SPACE = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The rows as files in the shared folder, without their lineage.

    A lost executor then costs the tasks it was running.  Spark removes the files when
    the DataFrame is no longer in use (spark.cleaner.referenceTracking.cleanCheckpoints).
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def with_few(df: DataFrame, few: DataFrame, on: Column, how: str) -> DataFrame:
    """Join of a large table with stored ids: broadcast while these are few, shuffled otherwise."""
    small = few.count() <= BROADCAST_IDS
    return df.join(F.broadcast(few) if small else few, on, how)


def with_own_ids(docs: DataFrame, operation: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``operation`` on ``docs`` with an id for each row that has none; these are null again in the result.

    ``operation`` keeps all columns.  An id is made from all columns of the row and its number among equal
    rows, so that a rerun makes the same ones; it comes after all usual ids.  Equal rows are
    numbered where they are read, then by task, so many of them are no load for any one.
    """
    unnamed = docs.where("doc_id is null")
    if unnamed.isEmpty():
        return operation(docs)
    columns = F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"})
    hashed = stored(unnamed.withColumns({"_row_hash": F.xxhash64(columns), "_part": F.spark_partition_id()}))
    # Equal rows of a task get numbers after those of the tasks before: only counts of (row, task) meet.
    counts = hashed.groupBy("_row_hash", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_row_hash").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(F.col("_row_hash").alias("_of_hash"), F.col("_part").alias("_of_part"), F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("_row_hash", "_part").orderBy("_row_hash"))
    numbered = hashed.withColumn("_within", within).join(
        offsets, (F.col("_row_hash") == F.col("_of_hash")) & (F.col("_part") == F.col("_of_part")))
    # Positive and of 63 bits, the second highest one set.
    own = F.xxhash64("_row_hash", F.col("_within") + F.col("_before")).bitwiseAND(F.lit(FIRST_OWN_ID - 1)).bitwiseOR(F.lit(FIRST_OWN_ID))
    given = numbered.withColumn("doc_id", own.cast(docs.schema["doc_id"].dataType)).select(*docs.columns)
    every = docs.where("doc_id is not null").withColumn("_unnamed", F.lit(False)).unionByName(
        stored(given.withColumn("_unnamed", F.lit(True)))
    )
    done = operation(every)
    return done.withColumn("doc_id", F.when(~F.col("_unnamed"), F.col("doc_id"))).drop("_unnamed")


def in_held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def whole_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
