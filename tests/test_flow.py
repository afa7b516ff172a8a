"""Sources, sinks, requests, inference and streams."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from reportweave import (
    Rejected,
    RateLimited,
    answered,
    append,
    append_responses,
    assemble_pages,
    build_requests,
    failed,
    flatten_categories,
    hist,
    infer,
    latest_counts,
    load_table,
    pending,
    read_batches,
    read_reports,
    read_responses,
    save_table,
    scratch_folder,
    stream_counts,
    stream_reports,
    stream_structured,
    structure,
    write_structured,
)
from reportweave.operators.inference import request_json
from reportweave.streaming.intake import read_response_stream

RESPONSES = [
    ("a", 'Q1. Yes, he said "stop".\n**Q2.** Waymo\nOther Vehicle: truck\n '),
    ("b", "Q1: No.\nQ2. Vehicle 1: 2019 Kia Soul, red\r\nQ6. Contributing Factors: rain, fog"),
    ("c", None),
]


@pytest.fixture()
def responses(spark):
    return spark.createDataFrame(RESPONSES, "report string, response string")


def test_read_reports(spark, tmp_path):
    (tmp_path / "one.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "two.pdf").write_bytes(b"x" * 100)
    (tmp_path / "note.txt").write_bytes(b"n")
    (tmp_path / "empty.pdf").write_bytes(b"")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.pdf").write_bytes(b"d")
    everything = read_reports(spark, str(tmp_path))
    assert {r.report: r.length for r in everything.collect()} == {"one.pdf": 6, "two.pdf": 100, "note.txt": 1, "empty.pdf": 0}
    assert read_reports(spark, str(tmp_path), glob="*.pdf").count() == 3


def test_csv_keeps_answers_whole(spark, responses, tmp_path):
    path = str(tmp_path / "answers")
    write_structured(responses, path, format="csv")
    back = read_responses(spark, path)
    assert {tuple(r) for r in back.collect()} == set(RESPONSES)
    assert back.dtypes == [("report", "string"), ("response", "string")]
    a, b = flatten_categories(structure(back)), flatten_categories(structure(responses))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_structured_table_keeps_types(spark, responses, tmp_path):
    table = structure(responses)
    write_structured(table, str(tmp_path / "t"))
    saved = load_table(spark, str(tmp_path / "t"))
    assert saved.dtypes == table.dtypes
    # An empty text and a missing one stay apart.
    vehicles = {r.report: r.q2_other_vehicle for r in saved.collect()}
    assert vehicles == {"a": "", "b": None, "c": None}
    write_structured(table, str(tmp_path / "c"), format="csv")
    text = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c"))
    cell = text.where("report = 'b'").first().q6_category
    assert json.loads(cell) == {"av_at_fault": None, "contributing_factors": ["rain", "fog"]}


def test_save_append_and_resume(spark, responses, tmp_path):
    path = str(tmp_path / "raw")
    append_responses(responses.where("report = 'a'"), path)
    todo = pending(responses.select("report"), load_table(spark, path))
    assert sorted(r.report for r in todo.collect()) == ["b", "c"]
    append_responses(responses.where("report <> 'a'"), path)
    assert load_table(spark, path).count() == 3
    save_table(responses.limit(1), str(tmp_path / "one"))
    save_table(responses.limit(2), str(tmp_path / "one"))
    assert load_table(spark, str(tmp_path / "one")).count() == 2


def test_requests(spark):
    pages = spark.createDataFrame(
        [("r", 2, bytearray(b"second" * 50)), ("r", 1, bytearray(b"\x00\xff")), ("s", 1, bytearray(b"z"))],
        "report string, page_no int, content binary",
    )
    requests = build_requests(assemble_pages(pages), 'What "happened"?')
    payload = {r.report: json.loads(r.j) for r in requests.select("report", request_json(F.col("messages")).alias("j")).collect()}
    message, = payload["r"]
    assert message["role"] == "user"
    text, first, second = message["content"]
    assert text == {"type": "text", "text": 'What "happened"?'}
    url = lambda content: "data:image/png;base64," + base64.b64encode(content).decode()
    assert first == {"type": "image_url", "image_url": {"url": url(b"\x00\xff"), "detail": "high"}}
    assert second["image_url"]["url"] == url(b"second" * 50)
    assert len(payload["s"][0]["content"]) == 2


def test_only_pages_are_exchanged(spark):
    pages = spark.createDataFrame([("r", 1, b"x"), ("s", 0, b"y")], "report string, page_no int, content binary")
    answers = infer(build_requests(assemble_pages(pages, tasks=3), "?"), lambda: lambda messages: messages[:5])
    plan = answers._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "content" in plan[plan.index("Exchange"):] and "to_json" not in plan[plan.index("Exchange"):]
    assert answers.rdd.getNumPartitions() == 3 and answers.count() == 2


def test_inference_policy(spark):
    def client_factory():
        calls = {}

        def call(messages):
            prompt = json.loads(messages)[0]["content"][0]["text"]
            calls[prompt] = calls.get(prompt, 0) + 1
            if prompt.startswith("slow") and calls[prompt] <= 2:
                raise RateLimited("wait")
            if prompt.startswith("never"):
                raise RateLimited("wait")
            if prompt.startswith("bad"):
                raise Rejected("no such image")
            if prompt.startswith("crash"):
                raise KeyError("x")
            return f"Q1. Yes, {prompt}."

        return call

    pages = spark.createDataFrame([(p, []) for p in ("fine", "slow", "never", "bad", "crash")],
                                  "report string, pages array<struct<page_no: int, content: binary>>")
    requests = build_requests(pages, F.col("report"))
    answers = infer(requests, client_factory, max_attempts=3, wait=0.0)
    got = {r.report: (r.status, r.attempts, r.response) for r in answers.collect()}
    assert got == {
        "fine": ("ok", 1, "Q1. Yes, fine."),
        "slow": ("ok", 3, "Q1. Yes, slow."),
        "never": ("rate_limited", 3, None),
        "bad": ("rejected", 1, None),
        "crash": ("failed", 1, None),
    }
    assert sorted(r.report for r in answered(answers).collect()) == ["fine", "slow"]
    assert {r.report: r.error for r in failed(answers).collect()}["crash"] == "KeyError: 'x'"
    assert append(answered(answers), answered(answers).select("response", "report")).count() == 4


def test_report_stream_in_bounded_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(7):
        (folder / f"r{i}.txt").write_text(f"Q1. {'Yes' if i % 2 else 'No'}, {i}.")
    sink, progress = str(tmp_path / "sink"), str(tmp_path / "progress")
    step = lambda files: files.select("report", F.decode("content", "UTF-8").alias("response"))
    stream_reports(spark, str(folder), sink, progress, every=3, step=step).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "sink").glob("batch=*")) == ["batch=0", "batch=1", "batch=2"]
    assert read_batches(spark, sink).count() == 7
    # A later start takes in new files only.
    (folder / "r7.txt").write_text("Q1. Yes, 7.")
    stream_reports(spark, str(folder), sink, progress, every=3, step=step).awaitTermination()
    table = structure(read_batches(spark, sink))
    assert [tuple(r) for r in hist(table, "q1_category").collect()] == [
        ("q1_category", "No", 4), ("q1_category", "Yes", 4)
    ]


def test_streams_equal_batch(spark, responses, tmp_path):
    source = str(tmp_path / "answers")
    responses.repartition(3).write.parquet(source)
    stream = read_response_stream(spark, source, every=1)
    stream_structured(stream, str(tmp_path / "t"), str(tmp_path / "p1")).awaitTermination()
    a, b = flatten_categories(spark.read.parquet(str(tmp_path / "t"))), flatten_categories(structure(responses))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    counted = structure(read_response_stream(spark, source, every=1))
    stream_counts(counted, "q1_category", str(tmp_path / "n"), str(tmp_path / "p2")).awaitTermination()
    got = {r.value: r.n for r in latest_counts(spark, str(tmp_path / "n")).collect()}
    assert got == {"Yes": 1, "No": 1, "Other": 1}


def test_scratch_folder_is_below_the_shared_one(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_folder(spark, "x"), scratch_folder(spark, "x")
    assert first.startswith(base + "/x-") and first != second


def test_saved_answers_keep_further_columns(spark, tmp_path):
    path = tmp_path / "answers.csv"
    path.write_text('note,response,report\nn1,"1. yes\n2. no",a.pdf\n,"x ""y""",b.pdf\n', encoding="utf-8")
    saved = read_responses(spark, str(path))
    assert saved.columns == ["report", "response", "note"]
    assert sorted(map(tuple, saved.collect())) == [("a.pdf", "1. yes\n2. no", "n1"), ("b.pdf", 'x "y"', None)]
