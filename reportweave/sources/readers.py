"""Readers: report files, saved answers, saved tables, and what is still to be answered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_name
from .csv_records import read_csv_texts
from .listing import list_reports

RESPONSES_SCHEMA = "report string, response string"
REPORT_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def read_reports(
    spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False, empty_files: bool = True
) -> DataFrame:
    """Files of a folder, one row each: ``(report, path, modificationTime, length, content)``.

    ``report`` is the file name.  Subfolders are entered with ``recursive`` only, all files are taken
    unless ``glob`` says otherwise, and no order is promised.  Select what you
    need: without ``content`` only the listing is read.  Spark's own reader leaves out empty files, so they
    come from :func:`.listing.list_reports`; ``empty_files=False`` does without them, for stores that only Spark opens.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    filled = reader.load(path).select(file_name(F.col("path")).alias("report"), "*")
    if not empty_files:
        return filled
    empty = list_reports(spark, path, glob, recursive).where("length = 0").withColumn("content", F.lit(b""))
    return filled.where("length > 0").unionByName(empty)


def read_responses(spark: SparkSession, path: str, format: str = "csv", parallel: bool = True) -> DataFrame:
    """Saved answers: ``report``, ``response``, then all further columns as they come.

    CSV columns go by the names in the header, in any order, and are texts; the files of
    a folder have one header.  Answers span lines; a large file is still read by many tasks, see
    :mod:`.csv_records`.  With ``parallel=False`` each file is read by one, for CSV with single quotes in
    fields that are not quoted.
    """
    if format == "csv" and parallel:
        saved = read_csv_texts(spark, path)
    elif format == "csv":
        reader = (
            spark.read.option("header", True)
            .option("multiLine", True)
            .option("escape", '"')
            .option("enforceSchema", False)
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
        )
        saved = reader.csv(path)
    else:
        saved = spark.read.format(format).load(path)
    return saved.select("report", "response", *[c for c in saved.columns if c not in ("report", "response")])


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def pending(reports: DataFrame, responses: DataFrame, key: str = "report") -> DataFrame:
    """Reports without an answer yet.

    Pass the listing without ``content`` and read the files that are left
    afterwards; otherwise the join would move the files themselves.
    """
    return reports.join(responses.select(key), key, "left_anti")
