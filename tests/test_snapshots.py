"""Snapshots of a stream and the latest answer to each report."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from reportweave import read_latest, read_snapshot, snapshots, stream_latest, stream_snapshots


def test_snapshots_are_whole(spark, tmp_path):
    """A batch that fails is not seen, one that ran twice counts once, and rows a step makes are counted."""
    source, sink, progress = tmp_path / "reports", str(tmp_path / "sink"), str(tmp_path / "progress")
    source.mkdir()
    for i in range(7):
        (source / f"{i}.txt").write_text(f"line {i}\n" * (i + 1))
    fails = [True]

    def step(files):
        if fails[0] and files.where("report = '6.txt'").count():
            raise RuntimeError("stopped")
        return files.select("report", F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where("line <> ''")

    def run():
        stream_snapshots(spark, str(source), sink, progress, every=2, step=step, glob="*.txt").awaitTermination()

    with pytest.raises(StreamingQueryException):
        run()
    seen = snapshots(spark, sink).collect()
    assert 0 < len(seen) < 4 and read_snapshot(spark, sink).where("report = '6.txt'").count() == 0
    fails[0] = False
    run()
    rows = snapshots(spark, sink).orderBy("batch").collect()
    assert [r.total_files for r in rows] == [2, 4, 6, 7] and rows[-1].total_rows == 28
    assert read_snapshot(spark, sink).count() == 28
    assert read_snapshot(spark, sink, total_files=5).count() == rows[1].total_rows
    # A second try of a batch that counts already, and a batch after one that is missing.
    schema = "batch long, folder string, files long, n_rows long"
    again = [(1, "zzz", 2, rows[1].n_rows), (9, "later", 2, 5)]
    spark.createDataFrame(again, schema).write.mode("append").parquet(f"{sink}/commits")
    assert [r.total_rows for r in snapshots(spark, sink).orderBy("batch").collect()] == [r.total_rows for r in rows]
    with pytest.raises(ValueError):
        read_snapshot(spark, sink, total_files=1)


def test_latest_answers_in_any_order(spark, tmp_path):
    deliveries = [
        [("a", "old", 1), ("b", "only", 1), ("c", None, 1)], [("a", "new", 3), ("c", "text", 1)],
        [("a", "older", 2), ("b", "only", 1)], [("a", "new", 3)],
    ]
    expected = {"a": ("new", 3), "b": ("only", 1), "c": ("text", 1)}
    for name, order in {"forward": [0, 1, 2, 3], "backward": [3, 2, 1, 0], "mixed": [2, 0, 1, 0]}.items():
        source, sink, progress = (str(tmp_path / name / part) for part in ("answers", "sink", "progress"))
        for i in order:
            delivery = spark.createDataFrame(deliveries[i], "report string, response string, answered_at int")
            delivery.write.mode("append").parquet(source)
            stream = spark.readStream.schema(delivery.schema).parquet(source)
            stream_latest(stream, sink, progress).awaitTermination()
        found = {r.report: (r.response, r.answered_at) for r in read_latest(spark, sink).collect()}
        assert found == expected


def test_latest_answers_are_kept_on_disk(spark, tmp_path):
    """The state grows with the reports, so it is not in the memory of the executors; the session's own setting stays."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for i, rows in enumerate([[("a", "x", 1), ("b", "x", 2)], [("a", "y", 1), ("b", "z", 1)], [("a", "y", 1)]]):
        spark.createDataFrame(rows, "report string, response string, answered_at int").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("report string, response string, answered_at int").parquet(str(tmp_path / "in"))
        stream_latest(stream, str(tmp_path / "sink"), str(tmp_path / "progress")).awaitTermination()
        assert "RocksDBStateStoreProvider" in (tmp_path / f"progress/offsets/{i}").read_text()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    latest = read_latest(spark, str(tmp_path / "sink"))
    assert {tuple(r) for r in latest.collect()} == {("a", "y", 1), ("b", "x", 2)}
