"""Document fingerprints by SimHash, with DataFrame functions only.

Terms are pairs of neighbouring words; each votes with its number of characters, up to 64, so
pairs of short, common words weigh less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reportweave.llm.common import stored, whole_text, with_few
from reportweave.llm.votes import hex_of, simhash_votes, terms, within_radius, words

RADIUS = 3
# Ids that share a task when texts meet their successors: no more texts than that in one window.
BLOCK = 256


def fingerprint(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``fp``, one row per distinct keys, from whole texts."""
    each = rows.select(*keys, F.explode(terms(words(F.col(text)))).alias("t"))
    length = F.length("t.0") + F.coalesce(F.length("t.1"), F.lit(0))
    return simhash_votes(each, keys, F.xxhash64("t.0", "t.1"), F.least(length, F.lit(64)))


def next_in_order(values: DataFrame, column: str) -> DataFrame:
    """``(value, next_value)`` of distinct values in ascending order; the last is followed by the first.

    Values are sorted by ranges; each partition then knows all but the successor of its
    last value, which is the first of the next partition.  Only one row per partition is
    ordered in one place.
    """
    ordered = values.select(F.col(column).alias("value")).distinct().orderBy("value")
    placed = stored(ordered.withColumn("part", F.spark_partition_id()))
    within = F.lead("value").over(W.partitionBy("part").orderBy("value"))
    firsts = placed.groupBy("part").agg(F.min("value").alias("first"))
    following = F.coalesce(F.lead("first").over(W.orderBy("first")), F.min("first").over(W.partitionBy()))
    ends = firsts.select(F.col("part").alias("of_part"), following.alias("after"))
    known = placed.withColumn("within", within).join(ends, F.col("part") == F.col("of_part"))
    return known.select("value", F.coalesce("within", "after").alias("next_value"))


def with_next(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, next_id, next_text)``: every document with the one that follows by ascending doc_id.

    The last is followed by the first.  Documents of BLOCK neighbouring ids meet in one
    task; the last of each block gets the first text of the next block by a join.  Of
    rows with the same id, each is followed by the next in order of text, the last of them by
    the next id.  Rows without an id are followed by nothing: both columns are null.
    """
    texts = docs.select("doc_id", whole_text(F.col("text")).alias("text"))
    block = F.floor(F.col("doc_id") / F.lit(BLOCK)).cast("long")
    heads = stored(texts.where("doc_id is not null").groupBy(block.alias("block")).agg(F.min("doc_id").alias("head")))
    turns = stored(next_in_order(heads, "head"))
    # A head without a successor but itself follows itself: a table of one block.
    after = heads.join(turns, F.col("head") == F.col("value")).select(F.col("block").alias("of_block"), "next_value")
    wanted = stored(turns.select(F.col("next_value").alias("wanted")))
    first_texts = with_few(texts, wanted, F.col("doc_id") == F.col("wanted"), "inner").groupBy("wanted").agg(
        F.min("text").alias("first_text")
    )
    after = after.join(first_texts, F.col("next_value") == F.col("wanted")).select("of_block", "next_value", "first_text")
    order = W.partitionBy("block").orderBy("doc_id", "text")
    placed = texts.where("doc_id is not null").withColumn("block", block).select(
        "*", F.lead("text").over(order).alias("lead_text"), F.lead("doc_id").over(order).alias("lead_id")
    )
    known = placed.join(after, F.col("block") == F.col("of_block"), "left").select(
        "doc_id", "text", F.coalesce("lead_id", "next_value").alias("next_id"),
        F.when(F.col("lead_id").isNull(), F.col("first_text")).otherwise(F.col("lead_text")).alias("next_text"),
    )
    alone = texts.where("doc_id is null").select(
        "doc_id", "text", F.lit(None).cast("long").alias("next_id"), F.lit(None).cast("string").alias("next_text")
    )
    return known.unionByName(alone)


def edited(text: Column, next_text: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the next text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(F.coalesce(next_text, F.lit("")), F.lit(1), half))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def neighbours(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(near_fp, n_near)``: for each fingerprint that has any, how many different ones are within ``radius`` bits."""
    pairs = within_radius(fingerprints, radius)
    both = pairs.select(F.explode(F.array("a", "b")).alias("near_fp"))
    return both.groupBy("near_fp").agg(F.count(F.lit(1)).alias("n_near"))


def document_fingerprints(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near)``.

    ``n_near`` counts the other fingerprints of the table within ``radius`` bits.  A null
    text is an empty one, and a text without letters or digits has fingerprint zero.  A row
    without an id is edited with nothing, and its near_next is null.  Repeated rows are
    returned each; where an id has several texts, near_next is taken to the smallest of its
    fingerprints.  Further columns are not read.
    """
    # Row numbers follow the order of ids and texts within a partition, so a task that is run again makes the same.
    paired = with_next(docs).withColumn("row", F.monotonically_increasing_id())
    changed = edited(F.col("text"), F.col("next_text"))
    facts = ["row", "doc_id", "next_id", "n_chars", "edited_sha256", "which"]
    versions = paired.select(
        "row", "doc_id", "next_id", F.length("text").cast("long").alias("n_chars"), "text", changed.alias("changed")
    ).withColumn("edited_sha256", F.sha2("changed", 256))
    both = versions.select(
        *facts[:-1], F.explode(F.array(
            F.struct(F.lit(0).alias("which"), F.col("text").alias("version")),
            F.struct(F.lit(1).alias("which"), F.col("changed").alias("version")),
        )).alias("v"),
    ).select(*facts[:-1], "v.which", "v.version")
    marked = fingerprint(both, facts, "version")
    own = F.max(F.when(F.col("which") == 0, F.col("fp")))
    other = F.max(F.when(F.col("which") == 1, F.col("fp")))
    each = stored(marked.groupBy(*facts[:-1]).agg(own.alias("fp"), other.alias("edited_fp")))
    by_id = each.where("doc_id is not null").groupBy(F.col("doc_id").alias("of_id")).agg(F.min("fp").alias("next_fp"))
    followed = each.join(by_id, F.col("next_id") == F.col("of_id"), "left")
    counted = followed.join(neighbours(each, radius), F.col("fp") == F.col("near_fp"), "left")
    return counted.select(
        "doc_id", "n_chars", "edited_sha256", hex_of(F.col("fp")).alias("fingerprint"),
        hex_of(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )
