"""A data source that lists the files of a folder, empty ones included.

Spark's file sources plan no task for a file without bytes.  This one plans its partitions over the listing
itself, so that every file gives a row and a count of files is the count of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTING_SCHEMA = "report string, path string, modificationTime timestamp, length long"
# Files that one task gives as rows.
FILES_PER_TASK = 10_000


class _Files(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class _ListingReader(DataSourceReader):
    def __init__(self, path: str, glob: str, recursive: bool):
        self.path, self.glob, self.recursive = path, glob, recursive

    def partitions(self) -> list[_Files]:
        from pyarrow import fs

        if "://" in self.path or self.path.startswith("file:"):
            scheme = self.path.split(":", 1)[0] + ":"
            store, folder = fs.FileSystem.from_uri(self.path if scheme != "file:" else "file://" + "/" + self.path[5:].lstrip("/"))
        else:
            scheme, (store, folder) = "file:", (fs.LocalFileSystem(), self.path)
        found = store.get_file_info(fs.FileSelector(folder, recursive=self.recursive))
        rows = [
            (info.base_name, f"{scheme}{'' if scheme == 'file:' else '//'}{info.path}", info.mtime, info.size)
            for info in sorted(found, key=lambda info: info.path)
            if info.type == fs.FileType.File and not info.base_name.startswith(("_", ".")) and fnmatch(info.base_name, self.glob)
        ]
        return [_Files(rows[i : i + FILES_PER_TASK]) for i in range(0, len(rows), FILES_PER_TASK)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        yield from partition.rows


class ReportListing(DataSource):
    """``spark.read.format("report_listing")`` with the options ``path``, ``glob`` and ``recursive``."""

    @classmethod
    def name(cls) -> str:
        return "report_listing"

    def schema(self) -> str:
        return LISTING_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        recursive = self.options.get("recursive", "false").lower() == "true"
        return _ListingReader(self.options["path"], self.options.get("glob", "*"), recursive)


def list_reports(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """Every file of a folder: ``(report, path, modificationTime, length)``, without its content.

    Hidden files (``_`` or ``.`` in front) are left out, as by Spark's own sources, and ``glob`` is a pattern with
    ``*``, ``?`` and ``[...]`` for the file name.  The store has to be one that Arrow opens: a local or mounted folder,
    HDFS, S3, GCS or Azure.
    """
    spark.dataSource.register(ReportListing)
    reader = spark.read.format("report_listing").option("recursive", str(recursive).lower())
    return (reader.option("glob", glob) if glob else reader).load(path)
