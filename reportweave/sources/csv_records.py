"""CSV whose fields span lines, read by as many tasks as the files have splits.

A line break ends a record if the number of quotes before it is even.  The quotes of each split are counted,
and their running sum over the splits of a file says whether a split begins inside a field.  Knowing that, each
split cuts its lines into records by itself; only the pieces of records that cross a border meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUOTE = '"'
_PIECES = "file string, block long, place int, kind string, text string"
# Records that a task hands on at a time.
_AT_A_TIME = 2000


def _cut(batches: Iterator[pa.RecordBatch], header: bool) -> Iterator[pa.RecordBatch]:
    """Records and border pieces of splits, whose lines come in order.

    ``head`` is what a record of an earlier split goes on with, and ``last head`` ends it; ``tail`` begins a
    record that does not end here.
    """
    out: list[tuple] = []
    split, inside, held, began_here, first = None, False, [], True, False

    def piece(kind: str) -> None:
        nonlocal held, first
        text = "\n".join(held)
        held = []
        if kind == "record" and first:
            first = False
            return
        out.append((*split, 0 if "head" in kind else 1, kind, text))

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        out.clear()
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "block", "place", "kind", "text"])

    for some in batches:
        rows = some.to_pydict()
        for file, block, opens, line in zip(rows["file"], rows["block"], rows["opens"], rows["value"], strict=True):
            if (file, block) != split:
                if held:
                    piece("tail" if began_here else "head")
                split, inside, began_here, first = (file, block), opens, not opens, header and block == 0
            held.append(line)
            inside ^= line.count(QUOTE) % 2 == 1
            if not inside:
                piece("record" if began_here else "last head")
                began_here = True
            if len(out) >= _AT_A_TIME:
                yield batch()
    if held:
        piece("tail" if began_here else "head")
    yield batch()


def csv_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """``(record)``: every record of the CSV files as text, line breaks within fields included.

    Quotes within fields are doubled, and fields with quotes or line breaks are quoted (RFC 4180).  Empty records
    are left out, and so is the first one of each file with ``header``, which has to fit its first split.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE)))
    splits = lines.groupBy("file", "block").agg(F.sum(quotes).alias("n"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    opens = splits.select("file", "block", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("opens"))
    # One row per split goes to the lines, which stay where they are read.
    known = lines.join(F.broadcast(opens), ["file", "block"]).sortWithinPartitions("file", "block", "seq")
    pieces = known.select("file", "block", "opens", "value").mapInArrow(lambda batches: _cut(batches, header), _PIECES)

    whole = pieces.where("kind = 'record'").select("text")
    borders = pieces.where("kind <> 'record'")
    number = F.count_if(F.col("kind") == "tail").over(W.partitionBy("file").orderBy("block", "place"))
    joined = borders.withColumn("number", number).groupBy("file", "number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "place", "text"))), lambda p: p["text"]), "\n").alias("text"))
    records = whole.union(joined.select("text"))
    return records.select(F.rtrim("text", F.lit("\r")).alias("record")).where("record <> ''")


def read_csv_texts(spark: SparkSession, path: str) -> DataFrame:
    """All columns as texts, by the names in the header, which the files of a folder share."""
    options = {"quote": QUOTE, "escape": QUOTE, "multiLine": "true",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    names = spark.read.options(header=True, **options).csv(path).columns
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    return csv_records(spark, path).select(F.from_csv("record", schema, options).alias("r")).select("r.*")
