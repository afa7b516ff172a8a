"""Runs: listing with empty files, CSV records across splits, counts of a pass, inference that is killed."""

import csv
import random

import pytest
from pyspark.errors import StreamingQueryException
from reportweave import Pace, RateLimited, Rejected, RunCounts, committed, infer_restartable, list_reports, read_reports
from reportweave import read_responses, structure, write_run
from reportweave.sources.csv_records import read_csv_texts
from reportweave.streaming.inference import Budget, ask


# --- listing --------------------------------------------------------------------


def test_listing_has_every_file(spark, tmp_path):
    for name, data in {"a.txt": b"", "b.txt": b"xy", "c.pdf": b"", "_SUCCESS": b"", ".a.crc": b"1"}.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.txt").write_bytes(b"")
    path = str(tmp_path)
    assert sorted((r.report, r.length) for r in list_reports(spark, path).collect()) == [("a.txt", 0), ("b.txt", 2), ("c.pdf", 0)]
    assert sorted(r.report for r in list_reports(spark, f"file://{path}", "*.txt", recursive=True).collect()) == ["a.txt", "b.txt", "d.txt"]
    read = read_reports(spark, path, glob="*.txt")
    assert sorted((r.report, bytes(r.content)) for r in read.collect()) == [("a.txt", b""), ("b.txt", b"xy")]
    assert {r.path for r in read.collect()} == {r.path for r in list_reports(spark, path, "*.txt").collect()}
    assert read_reports(spark, path, empty_files=False).count() == 1
    (tmp_path / "none").mkdir()
    assert list_reports(spark, f"{path}/none").count() == 0


# --- CSV ------------------------------------------------------------------------


@pytest.mark.parametrize("split", [40, 97, 1 << 20])
def test_records_across_splits(spark, tmp_path, split):
    """Fields that span lines and splits, quotes at borders, two files, either line end."""
    rng = random.Random(split)
    rows = []
    for name, end in (("one.csv", "\n"), ("two.csv", "\r\n")):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as f:
            writer = csv.writer(f, lineterminator=end, quoting=csv.QUOTE_ALL)
            writer.writerow(["response", "report", "more, or\"less"])
            for i in range(80):
                text = "".join(rng.choice(['"', "\n", "\r\n", ",", "é", " ", "a b", ""]) for _ in range(rng.randint(0, 40)))
                rows.append((text + ".", f"{name}-{i}", rng.choice(["x", '""', "\n\n", "y" * 150])))
                writer.writerow(rows[-1])
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        frame = read_csv_texts(spark, str(tmp_path))
        assert frame.columns == ["response", "report", 'more, or"less']
        assert sorted(map(tuple, frame.collect())) == sorted(rows)
        found = read_responses(spark, str(tmp_path))
        assert found.columns[:2] == ["report", "response"]
        assert {(r.report, r.response) for r in found.collect()} == {(b, a) for a, b, _ in rows}
        # Spark's own reader turns line ends within fields into those of the file's kind; up to that, it is the same.
        serial = {r.report: r.response.replace("\r", "") for r in read_responses(spark, str(tmp_path), parallel=False).collect()}
        assert serial == {b: a.replace("\r", "") for a, b, _ in rows}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


# --- counts ---------------------------------------------------------------------


def test_counts_come_from_the_pass_that_writes(spark, tmp_path):
    rows = [("a", "Q1. Yes.\nQ2. Waymo\nOther Vehicle: truck"), ("b", "Q1. No.\nQ2. ?"), ("c", None), ("d", "zzz")]
    responses = spark.createDataFrame(rows, "report string, response string").repartition(3)
    counts = write_run(responses, str(tmp_path / "t"), keep=lambda df: df.where("report <> 'd'"))
    assert (counts["processed"], counts["included"], counts["dropped"], counts["without_response"]) == (4, 3, 1, 1)
    assert counts["no_brand"] == 2 and spark.read.parquet(str(tmp_path / "t")).count() == 3
    run = RunCounts()
    frame = run.included(structure(run.processed(responses)))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1
    frame.write.format("noop").mode("overwrite").save()
    assert run.counts()["included"] == 4 and run.counts()["dropped"] == 0
    assert write_run(responses.limit(0), str(tmp_path / "none"))["processed"] == 0


# --- inference ------------------------------------------------------------------


def requests_of(spark, texts):
    rows = [(report, [("user", text)]) for report, text in texts.items()]
    return spark.createDataFrame(rows, "report string, messages array<struct<role: string, content: string>>").repartition(4, "report")


def client_with_log(path):
    """Notes each call in a file of its own."""

    def factory():
        def call(messages):
            with open(f"{path}/calls", "a") as log:
                log.write(messages + "\n")
            if "no" in messages:
                raise Rejected("never")
            return f"got {messages}"

        return call

    return factory


def test_a_killed_run_goes_on(spark, tmp_path):
    path, texts = str(tmp_path / "run"), {f"r{i}": f"text {i}" for i in range(30)}
    settings = {"pace": Pace(wait=0.0), "per_file": 1, "files_per_batch": 4}
    client = client_with_log(str(tmp_path))

    def kill(number):
        if number == 2:
            raise RuntimeError("killed")

    with pytest.raises(StreamingQueryException):
        infer_restartable(requests_of(spark, texts), client, path, on_batch=kill, **settings)
    before = committed(spark, path).count()
    assert 0 < before < 30
    done = infer_restartable(requests_of(spark, texts), client, path, **settings).collect()
    assert sorted(r.report for r in done) == sorted(texts)
    calls = (tmp_path / "calls").read_text().split("\n")[:-1]
    # Only those of the batch that was open are asked twice.
    assert len(set(calls)) == 30 and 30 < len(calls) <= 34
    # Nothing is left to ask; then one text changes and one report is new.
    infer_restartable(requests_of(spark, texts), client, path, **settings)
    assert len((tmp_path / "calls").read_text().split("\n")[:-1]) == len(calls)
    more = infer_restartable(requests_of(spark, {**texts, "r3": "changed", "new": "no"}), client, path, **settings)
    assert more.count() == 32 and more.where("report = 'r3'").count() == 2
    assert more.where("status = 'rejected'").first().report == "new"
    # What failed is asked again and answered by another client.
    again = infer_restartable(requests_of(spark, {"new": "no"}), lambda: lambda messages: "yes", path, ask_failed_again=True, **settings)
    assert again.where("report = 'new'").first().response == "yes" and again.count() == 32


def test_no_requests(spark, tmp_path):
    none = requests_of(spark, {"x": "y"}).limit(0)
    assert infer_restartable(none, client_with_log(str(tmp_path)), str(tmp_path / "run")).count() == 0


def test_pace():
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    budget = Budget(30, lambda: now[0], sleep)
    for _ in range(4):
        budget.take()
    assert slept == [2.0, 2.0, 2.0]
    pace = Pace(attempts=4, wait=10, longest=25)
    delays = [pace.delay(n, "key") for n in (1, 2, 3)]
    assert 5 <= delays[0] <= 10 and 10 <= delays[1] <= 20 and 12.5 <= delays[2] <= 25
    assert delays == [pace.delay(n, "key") for n in (1, 2, 3)] and delays[0] != pace.delay(1, "other")
    slept.clear()

    def busy(messages):
        raise RateLimited("later")

    free = Budget(None, lambda: now[0], sleep)
    assert ask(busy, "key", "m", pace, free, sleep) == (None, "rate_limited", "later", 4)
    assert slept == delays
    assert ask(lambda m: 1 / 0, "key", "m", pace, free, sleep)[1:] == ("failed", "ZeroDivisionError: division by zero", 1)
