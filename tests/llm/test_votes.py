"""Votes of long texts weigh like those of short ones."""

from pyspark.sql import functions as F

from reportweave.llm.fingerprints import fingerprint


def test_a_text_of_many_megabytes_has_the_weights_of_a_short_one(spark):
    part = "a of notwithstanding the extraordinary b c d " * 40
    docs = spark.createDataFrame([(1, part, 1), (2, part, 9600)], "doc_id long, part string, times int")
    texts = docs.select("doc_id", F.expr("repeat(part, times)").alias("text"))
    assert texts.agg(F.max(F.length("text"))).first()[0] > 1 << 24
    found = fingerprint(texts, ["doc_id"], "text").collect()
    assert len(found) == 2 and found[0].fp == found[1].fp
