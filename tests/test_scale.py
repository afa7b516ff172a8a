"""Work is dealt out by rows, whatever the splits, files and row groups of the input."""

import unicodedata

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from catalog import queries as catalog
from reportweave import latest_counts, read_responses, write_structured
from reportweave.functions import text as T
from reportweave.llm import near_dedup
from reportweave.operators import lookup, statistics
from reportweave.session import spread
from reportweave.sources import csv_records, writers
from reportweave.streaming import intake


def sizes(df):
    return df.groupBy(F.spark_partition_id().alias("task")).count().select("count").toPandas()["count"].tolist()


@pytest.fixture()
def orders_dir(spark, tmp_path):
    rows = spark.range(1, 1201).selectExpr(
        "id as o_orderkey", "id % 7 as o_custkey", "'O' as o_orderstatus", "1.0D as o_totalprice",
        "date'1995-01-01' as o_orderdate", "'1-URGENT' as o_orderpriority")
    rows.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


def test_spread_by_rows(spark):
    one_split = spark.range(0, 2000, 1, 1).select((F.col("id") * 0).alias("key"), "id")
    dealt = sizes(spread(one_split, 100))
    assert sum(dealt) == 2000 and len(dealt) == 20 and max(dealt) <= 110


def test_counts_keep_state_in_few_parts(spark, tmp_path):
    before = spark.conf.get(intake.STATE_PARTS)
    spark.conf.set(intake.STATE_PARTS, "37")
    try:
        spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "report string, response string").write.parquet(str(tmp_path / "in"))
        rows = intake.read_response_stream(spark, str(tmp_path / "in"))
        intake.stream_counts(rows, "response", str(tmp_path / "sink"), str(tmp_path / "progress")).awaitTermination()
        assert spark.conf.get(intake.STATE_PARTS) == "37"
    finally:
        spark.conf.set(intake.STATE_PARTS, before)
    parts = [p for p in (tmp_path / "progress" / "state" / "0").iterdir() if p.name.isdigit()]
    assert 0 < len(parts) <= spark.sparkContext.defaultParallelism
    assert {tuple(r) for r in latest_counts(spark, str(tmp_path / "sink")).collect()} == {("x", 2), ("y", 1)}


def test_answers_of_one_file_are_dealt_to_all_cores(spark, tmp_path):
    spark.range(0, 400, 1, 1).selectExpr("cast(id as string) as report", "'Q1. No.' as response").write.parquet(str(tmp_path / "in"))
    intake.stream_structured(
        intake.read_response_stream(spark, str(tmp_path / "in")), str(tmp_path / "sink"), str(tmp_path / "progress")).awaitTermination()
    assert len(list((tmp_path / "sink").glob("*.parquet"))) == spark.sparkContext.defaultParallelism
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 400


def test_answer_files_stay_few(spark, orders_dir, monkeypatch):
    monkeypatch.setattr(catalog, "ANSWER_FILES", 2)
    rows = spark.range(0, 30000).selectExpr("id as o_orderkey", "id as o_custkey", "'O' as o_orderstatus", "'1' as o_orderpriority")
    rows.write.parquet(f"{orders_dir}/more/orders.parquet")
    path = catalog._answer_files(spark, f"{orders_dir}/more", f"{orders_dir}/answers")
    answers = spark.read.parquet(path)
    assert answers.count() == 30000 and len(answers.inputFiles()) <= 4


def test_report_files_are_bounded(spark, orders_dir):
    path = catalog._report_files(spark, orders_dir, 10)
    held = spark.read.format("binaryFile").load(f"{path}/part=*").select(
        F.regexp_count(F.decode("content", "UTF-8"), F.lit(catalog.END)).alias("n")).toPandas()["n"]
    assert held.sum() == 1200 and held.max() <= 10
    whole = catalog._report_files(spark, orders_dir)
    assert spark.read.format("binaryFile").load(f"{whole}/part=*").count() == 25


def test_report_scan_reads_bounded_files(spark, orders_dir, monkeypatch):
    monkeypatch.setattr(catalog, "SCANNED_RESPONSES", 10)
    rows = catalog.report_scan(spark, orders_dir).collect()
    assert len(rows) == 25 and sum(r.n_responses for r in rows) == 1200 and all(r.n_bytes == r.listed for r in rows)


def test_responses_of_one_file_are_dealt_to_all_cores(spark):
    one = spark.createDataFrame([(bytearray(catalog.END.join(map(str, range(400))).encode() + b"\f"),)], "content binary").coalesce(1)
    dealt = sizes(catalog._file_responses(one))
    assert sum(dealt) == 400 and len(dealt) == spark.sparkContext.defaultParallelism


def test_csv_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "CSV_RECORDS", 10)
    rows = spark.range(0, 95, 1, 1).selectExpr("cast(id as string) as report", "concat('a', chr(10), id) as response")
    write_structured(rows, str(tmp_path / "csv"), format="csv")
    assert len(list((tmp_path / "csv").glob("*.csv"))) == 10
    assert {tuple(r) for r in read_responses(spark, str(tmp_path / "csv")).collect()} == {(str(i), f"a\n{i}") for i in range(95)}


def test_the_structured_table_is_packed(spark, orders_dir, tmp_path, monkeypatch):
    """The whole table as CSV is many times as large as the tables that it is made from."""
    monkeypatch.setattr(catalog, "scratch_folder", lambda spark, purpose: str(tmp_path / purpose))
    counts = catalog.QUERIES["structured_csv"](spark, orders_dir).collect()
    files = list((tmp_path / "csv").glob("part-*"))
    assert sum(r.n for r in counts) == 1200
    assert files and all(f.name.endswith(".csv.gz") for f in files)


def test_csv_lines_are_not_exchanged(spark, tmp_path):
    (tmp_path / "a.csv").write_text('report,response\n"1","x\ny"\n')
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records = csv_records.csv_records(spark, str(tmp_path))
        plan = records._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert [r.record for r in records.collect()] == ['"1","x\ny"']
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_text_is_broadcast_by_lookups(spark):
    texts = spark.createDataFrame([(1, "one red car"), (2, "blue"), (3, None)], "id int, text string")
    rules = spark.createDataFrame([(1, "warm", "red"), (2, "cold", "blue")], "priority int, category string, keyword string")
    found = lookup.keyword_lookup(texts, "text", rules)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.category) for r in found.collect()} == {(1, "warm"), (2, "cold"), (3, "unknown")}


def test_quantiles_of_values_in_several_rows(spark):
    rows = spark.createDataFrame([(v, 1) for v in [5.0, 1.0, 5.0, 5.0, 2.0, 9.0, 5.0]], "v double, n long")
    assert statistics.quantiles(rows, [], [0.25, 0.5, 1.0]).first().q == [2.0, 5.0, 9.0]


def test_residuals_are_not_counted_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(statistics, "_counted", None)
    rows = spark.range(200).selectExpr("cast(id as double) as x", "id * 2.0D as y")
    fits = statistics.lowess(rows, "x", "y", points=5, bandwidth=40, rounds=2).collect()
    assert len(fits) == 5 and all(abs(r.fit - 2 * r.x) < 1e-6 for r in fits)


def test_slugs_of_every_character(spark):
    texts = [f"a{chr(c)}b" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(i, "|".join(texts[i : i + 64])) for i in range(0, len(texts), 64)], "i int, text string")
    expected = {i: unicodedata.normalize("NFKD", "|".join(texts[i : i + 64])).encode("ascii", "ignore").decode() for i in range(0, len(texts), 64)}
    assert {r.i: r.form for r in rows.select("i", T._ascii_form(F.col("text")).alias("form")).collect()} == expected
    plan = rows.select(T.slugify(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan


def test_pipeline_drops_near_fingerprints(spark, tmp_path):
    # The repeated words decide the fingerprint, the sets of shingles have next to nothing in common.
    texts = ["x y z " * 200 + " ".join(f"{w}{i}" for i in range(100)) for w in ("one", "two")]
    docs = spark.createDataFrame(
        [(1, texts[0]), (2, texts[1]), (3, "quite another text of some words"), (None, texts[0])], "doc_id long, text string")
    assert {r.doc_id for r in near_dedup.without_near_duplicates(docs).collect()} == {1, 2, 3}
    assert {r.doc_id for r in near_dedup.without_near_fingerprints(docs).collect()} == {1, 3}
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()} == {1, 3}
