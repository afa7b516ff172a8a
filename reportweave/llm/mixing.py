"""Mixing sources to target weights by weighted fair queueing.

Every document gets a virtual finish time: the tokens of its source up to and with it,
in shuffled order, divided by the source's weight.  Sorting all documents by that time
interleaves the sources in proportion to their weights; the mix ends at a total budget.
A source that runs out starts anew, up to ``repeats`` times.

The cut is known before the sort.  With sizes S and weights w, a source has given
``min(repeats * S, w * V)`` tokens by virtual time V; the V at which these add up to the
budget is found from one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reportweave.llm.common import ASCII_SPACE, stored, whole_text, with_own_ids

# Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
REPEATS = 3
# Hexadecimal digits of the shuffled order that split a source for its running totals.
SPLIT_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(whole_text(text), F.lit(ASCII_SPACE)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``(source, source_size, weight, target)`` from ``(source, size)``; the budget is the sum of all sizes.

    One row per source is all that is ordered as a whole.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.asc_nulls_last("source")))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int"))
    weighed = by_source.withColumn("weight", weight.cast("long"))
    weighed = weighed.withColumn("full_at", repeats * F.col("source_size") / F.col("weight"))
    # Sources are full in this order.  If those before one are full, the rest reach this
    # level; it rises until the first source that is not full, and falls from there on.
    order = W.orderBy("full_at", F.asc_nulls_last("source"))
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(repeats * F.sum("source_size").over(before), F.lit(0))
    levels = weighed.withColumn("level", left / F.sum("weight").over(after))
    end = F.max("level").over(everything)
    target = F.least(F.col("weight") * end, (repeats * F.col("source_size")).cast("double"))
    return levels.select("source", "source_size", "weight", target.alias("target"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``(doc_id, source, size, source_size, weight, target, finish, copies)`` of every document.

    ``finish`` is the virtual finish time of the first copy; a copy is in the mix if at
    least half of it lies before the cut.  Running totals are taken within slices of a
    source's shuffled order and moved by the totals of the slices before, so no task holds
    a source.  The order is the MD5 of doc_id: reruns agree, and rows of the same id are
    ordered by size.  A null text has size 0, a null source is a source (the last one), and
    a null doc_id is ordered as an empty string.
    """
    slot = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), slot.alias("slot")))
    sliced = sizes.withColumn("slice", F.substring("slot", 1, SPLIT_DIGITS))
    totals = sliced.groupBy("source", "slice").agg(F.sum("size").alias("total"))
    upto = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select("source", "slice", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("base"))
    slices = base.join(source_targets(sizes, weights, repeats).withColumnRenamed("source", "name"),
                       F.col("source").eqNullSafe(F.col("name"))).drop("name")
    slices = slices.withColumnsRenamed({"source": "of_source", "slice": "of_slice"})
    running = W.partitionBy("source", "slice").orderBy("slot", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = sliced.withColumn("in_slice", F.sum("size").over(running)).join(
        slices, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("slice") == F.col("of_slice"))
    )
    done = F.col("base") + F.col("in_slice")
    taken = [
        (2 * (e * F.col("source_size") + done) - F.col("size") <= 2 * F.col("target")).cast("int")
        for e in range(repeats)
    ]
    return placed.select(
        "doc_id", "source", "size", "source_size", "weight", "target",
        (done / F.col("weight")).alias("finish"), sum(taken[1:], taken[0]).alias("copies"),
    )


def mix_sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``: what the mix takes of every document."""
    return mix_plan(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The mix itself: documents in the order of their virtual finish times, copies repeated.

    All columns of ``docs``, then ``mix_copy`` (0 for the first) and ``mix_time``.  Rows
    without a doc_id are mixed like any other; rows that repeat an id are taken once each,
    as often as the plan says for the first of them.
    """
    return with_own_ids(docs, lambda named: _mixed(named, weights, repeats))


def _mixed(docs: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    plan = mix_plan(docs, weights, repeats)
    of_id = plan.groupBy(F.col("doc_id").alias("_mix_id")).agg(
        F.min_by(F.struct((F.col("source_size") / F.col("weight")).alias("lap"), "finish", "copies"), "finish").alias("_mix")
    )
    joined = docs.join(of_id, F.col("doc_id") == F.col("_mix_id"))
    each = joined.where("_mix.copies > 0").select(
        *[docs[c] for c in docs.columns], "_mix",
        F.explode(F.sequence(F.lit(0), F.col("_mix.copies") - 1)).alias("mix_copy"),
    )
    timed = each.withColumn("mix_time", F.col("_mix.finish") + F.col("mix_copy") * F.col("_mix.lap")).drop("_mix")
    return timed.orderBy("mix_time", "doc_id", "mix_copy")
