"""A rarest-gram index for substring search between two tables.

Every needle is filed under its rarest gram, counted over the haystacks, as a shape: the gram, where it
stands in the needle, and how long the needle is.  A haystack looks up the grams it holds and cuts
out one piece for each shape it meets; pieces that are equal to a needle are the matches.
There are far fewer shapes than needles, so nothing is paired, and a haystack gives
as many rows as it has characters, whatever the number and the lengths of the needles.  Needles whose
rarest gram is frequent are filed under a longer gram, that one and those behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

# Lengths of grams, and the occurrences from which a gram is frequent.
GRAMS, FREQUENT = (3, 8), 1000


def shuffled(rows: DataFrame) -> DataFrame:
    """Rows that no join sends through the driver.

    Spark judges a table by the bytes of its files; unpacked texts, and what is cut out of them, are far larger.
    """
    return rows.hint("merge")


def characters(text: Column) -> Column:
    """Code points as an array, so that a place is found in one step."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _grams(text: Column, q: int) -> Column:
    """All pieces of q characters, in order; a shorter text has none."""

    def of(chars: Column) -> Column:
        last = F.size(chars) - q + 1
        pieces = F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.concat(*[F.get(chars, i + k) for k in range(q)]))
        return F.when(last > 0, pieces)

    return let(characters(text), of)


def _places(rows: DataFrame, key: Column, text: Column, q: int) -> DataFrame:
    """``(key, place, gram)``, one row per gram."""
    return rows.select(key.alias("key"), F.posexplode(_grams(text, q)).alias("place", "gram"))


def _filed(needles: DataFrame, places: DataFrame, q: int, few: bool) -> DataFrame:
    """``(key, gram, offset, n)`` of the needles of q characters or more all of whose grams occur.

    ``n`` is how often the gram occurs in the haystacks.
    """
    own = _places(needles, F.col("key"), F.col("needle"), q)
    if few:
        places = places.join(F.broadcast(own.select("gram").distinct()), "gram", "left_semi")
    occurs = places.groupBy(F.col("gram").alias("of_gram")).agg(F.count(F.lit(1)).alias("n"))
    met = own.join(shuffled(occurs), F.col("gram") == F.col("of_gram"), "left")
    # The largest place is the number of grams less one; a gram that is nowhere has no count.
    rarest = met.groupBy("key").agg(
        F.min(F.struct("n", "gram", "place")).alias("r"), F.bool_or(F.col("n").isNull()).alias("nowhere"))
    return rarest.where("not nowhere").select(
        F.col("key").alias("of_key"), F.col("r.gram").alias("gram"), F.col("r.place").alias("offset"), F.col("r.n").alias("n"))


def pieces_like(
    rows: DataFrame, column: str, needles: DataFrame, needle: str, keep: list[str], name: str,
    grams: tuple[int, ...] = GRAMS, frequent: int = FREQUENT, few: bool = False,
) -> DataFrame:
    """``(*keep, name)``: pieces of a column, among them each that is equal to a needle of ``grams[0]`` characters or more.

    With ``few`` needles, their grams and shapes go to the haystacks, whose grams then are not shuffled.
    Pieces of a row differ from each other.  Null texts have none.  Characters are code points.
    """
    key = F.unhex(F.md5(F.col(needle)))
    left = needles.where(F.length(needle) >= grams[0]).select(key.alias("key"), F.col(needle).alias("needle"))
    of_text = F.xxhash64(column)
    meetings = None
    for level, q in enumerate(grams):
        places = _places(rows, of_text, F.col(column), q)
        filed = shuffled(left).join(_filed(left, places, q, few), F.col("key") == F.col("of_key"))
        longer = grams[level + 1] if level + 1 < len(grams) else None
        stays = F.lit(True) if longer is None else (F.col("n") < frequent) | (F.length("needle") < longer)
        shapes = filed.where(stays).select(
            F.col("gram").alias("of_gram"), "offset", F.length("needle").alias("size")).distinct()
        haystacks, shapes = (places, F.broadcast(shapes)) if few else (shuffled(places), shapes)
        met = haystacks.join(shapes, F.col("gram") == F.col("of_gram")).select(
            F.col("key").alias("of_text"), (F.col("place") - F.col("offset")).alias("start"), "size").where("start >= 0")
        meetings = met if meetings is None else meetings.union(met)
        left = filed.where(~stays).select("key", "needle")
    # Two texts of the same hash only try each other's places.
    # A place is one number, a quarter of a struct.
    place = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("size").cast("long"))
    wanted = meetings.groupBy("of_text").agg(F.collect_set(place).alias("places"))
    found = shuffled(rows.withColumn("_text", of_text)).join(wanted, F.col("_text") == F.col("of_text"))

    def cut(chars: Column) -> Column:
        def start(p: Column) -> Column:
            return F.shiftright(p, 32).cast("int")

        def size(p: Column) -> Column:
            return p.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")

        fitting = F.filter("places", lambda p: start(p) + size(p) <= F.size(chars))
        return F.array_distinct(F.transform(fitting, lambda p: F.array_join(F.slice(chars, start(p) + 1, size(p)), "")))

    pieces = let(characters(F.col(column)), cut)
    return found.select(*keep, pieces.alias("_pieces")).select(*keep, F.explode_outer("_pieces").alias(name))
