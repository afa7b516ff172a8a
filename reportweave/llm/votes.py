"""SimHash with DataFrame functions: every term votes on 64 signed bits."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 64
# Two counters in one number, 32 bits apart.
_PAIR = (1 << 32) | 1
# Weights of a key have to stay below this in sum, so that its counters never meet.  Texts reach it at half a
# gigabyte, when their terms no longer fit into a row of Spark, and single lines at 149 MB.
MOST_WEIGHT = 1 << 30


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case; the first and the last may be empty."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def terms(of_words: Column) -> Column:
    """Pairs of neighbouring words and the last word: an array of structs ``(0, 1)``."""
    return F.arrays_zip(of_words, F.slice(of_words, 2, F.greatest(F.size(of_words), F.lit(1))))


def simhash_votes(rows: DataFrame, keys: list[str], term: Column, weight: Column, also: dict[str, Column] | None = None) -> DataFrame:
    """``keys`` and ``fp`` from one row per term: the weighted votes of each bit, summed and signed.

    ``also`` names other aggregates of the rows, which are numbers and follow as columns.

    A bit is 1 if the weight of the terms that set it is more than half of all; without
    weight, the fingerprint is 0.  The weights of a key add up to less than MOST_WEIGHT.
    Terms of a key are next to each other in a task, so they are added up before anything
    is shuffled.
    """
    also = also or {}
    hashed = rows.withColumns({"_h": term, "_w": weight.cast("long")})

    def pair(k: int) -> Column:
        """Bits k and k + 32 of the hash, each in its own counter."""
        return F.shiftrightunsigned("_h", k).bitwiseAND(F.lit(_PAIR)) * F.col("_w")

    summed = hashed.groupBy(*keys).agg(
        F.sum("_w").alias("_all"), *[F.sum(pair(k)).alias(f"_s{k}") for k in range(BITS // 2)],
        *[of_rows.alias(name) for name, of_rows in also.items()],
    )
    # Twice a counter, less all, is above 0 where a bit wins: it then reaches bit 30 of its half.
    short = (F.lit((MOST_WEIGHT - 1) * _PAIR) - F.col("_all") * _PAIR).alias("_short")
    counted = summed.select("*", short)

    def won(k: int) -> Column:
        both = F.shiftrightunsigned(2 * F.col(f"_s{k}") + F.col("_short"), 30).bitwiseAND(F.lit(_PAIR))
        return F.shiftleft(both, k)

    return counted.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), map(won, range(BITS // 2))).alias("fp"), *also)


def block_keys(fp: Column, radius: int) -> Column:
    """Keys of the permuted block tables: an array of numbers, each for a table and its blocks.

    The fingerprint is cut into radius + 2 blocks.  If radius bits differ or fewer, two blocks
    or more are equal; there is a table for every two blocks.
    """
    n = radius + 2
    cuts = [BITS * i // n for i in range(n + 1)]

    def block(i: int) -> Column:
        return F.shiftrightunsigned(fp, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1))

    pairs = list(combinations(range(n), 2))
    return F.array(*[
        F.shiftleft(F.shiftleft(block(a), cuts[b + 1] - cuts[b]).bitwiseOR(block(b)), len(pairs).bit_length())
        .bitwiseOR(F.lit(t)) for t, (a, b) in enumerate(pairs)
    ])


def within_radius(fingerprints: DataFrame, radius: int, accept: int | None = None) -> DataFrame:
    """``(a, b)``, a < b: pairs of different fingerprints (column ``fp``) by permuted block tables.

    All pairs of ``radius`` bits or fewer are found.  With ``accept``, what else meets in a
    table counts up to so many bits.  Equal keys are joined, not gathered.
    """
    if not 0 <= radius <= 6:
        raise ValueError("blocks would be too short or too wide for this radius")
    distinct = fingerprints.select("fp").distinct()
    table = distinct.select("fp", F.explode(block_keys(F.col("fp"), radius)).alias("key"))
    # Both sides are the same table, so it is shuffled once.
    a, b = F.col("left.fp"), F.col("right.fp")
    met = table.alias("left").join(table.alias("right"), (F.col("left.key") == F.col("right.key")) & (a < b))
    near = F.bit_count(a.bitwiseXOR(b)) <= (radius if accept is None else accept)
    return met.where(near).select(a.alias("a"), b.alias("b")).distinct()


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
