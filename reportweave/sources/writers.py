"""Writers: typed tables as Parquet, CSV for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Records of one CSV file.  Records span lines, so that plain readers give a file to one task.
CSV_RECORDS = 50_000


def nested_as_json(df: DataFrame) -> DataFrame:
    """Struct, array and map columns as JSON text, the others unchanged."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("struct", "array", "map")]
    return df.withColumns({
        c: F.to_json(F.col(c), {"ignoreNullFields": "false"}) for c in nested
    }) if nested else df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", compression: str | None = None) -> None:
    """CSV with header, nested columns as JSON; null and ``''`` read back alike.

    A file holds CSV_RECORDS records at most, whatever a task writes.  With ``compression`` (such as gzip) files are
    packed, which readers see by their names; a packed file is read by one task.
    """
    (
        nested_as_json(df).write.mode(mode)
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", CSV_RECORDS)
        .csv(path, compression=compression)
    )


def write_structured(
    df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite", compression: str | None = None,
) -> None:
    """The structured table, typed in Parquet or flattened to text in CSV; ``compression`` is that of the format by default."""
    if format == "csv":
        write_csv(df, path, mode, compression)
    else:
        writer = df.write.mode(mode).format(format)
        (writer.option("compression", compression) if compression else writer).save(path)


def append_responses(df: DataFrame, path: str) -> None:
    """Add answers to the table of raw answers."""
    df.select("report", "response").write.mode("append").parquet(path)


def save_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
