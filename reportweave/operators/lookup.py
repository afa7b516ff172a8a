"""Substring lookups against a dictionary, without pairing every text with every entry.

A dictionary of up to :data:`INLINE_LIMIT` entries, passed as Python values, becomes one
``CASE`` expression: no join and no shuffle.  A larger one, and any that is a table, is
matched through an index of rare grams (:mod:`.grams`), with the same results: the containing
side is cut into those pieces that may be equal to a text on the other side, and both sides meet in an
equi-join.  The cut side grows with its own text only, whatever the number of
entries, a match carries one row, and no side with texts is broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import first_match
from .grams import GRAMS, pieces_like, shuffled

INLINE_LIMIT = 200
SALTS = 16
# Rows of a text from which they are salted.
FREQUENT_ROWS = 10_000
# Keywords, and characters of all of them, up to which they go to the texts (some 20 MB), if there are so many of these.
FEW_KEYWORDS, FEW_CHARACTERS, MANY_TEXTS = 20_000, 200_000, 10_000
SUPPLEMENTARY = r"[\x{10000}-\x{10FFFF}]"


def _entries(dictionary: Mapping, nested: bool) -> list[tuple[int, str, str]]:
    """``(ord, key, val)`` in search order."""
    pairs = [
        (key, value)
        for key, values in dictionary.items()
        for value in (values if nested else [values])
    ]
    return [(i, key, value) for i, (key, value) in enumerate(pairs)]


def substrings(col: Column, lengths: Column) -> Column:
    """Distinct substrings of the given lengths (an array column), shorter texts give fewer."""

    def of_length(n: Column) -> Column:
        # A look-ahead matches at every position, so the pieces overlap.
        pattern = F.concat(F.lit("(?s)(?=(.{"), n.cast("string"), F.lit("}))"))
        return F.regexp_extract_all(col, pattern, F.lit(1))

    usable = F.filter(lengths, lambda n: (n > 0) & (n <= F.length(col)))
    pieces = F.array_distinct(F.flatten(F.transform(usable, of_length)))
    # A supplementary character is two code units, and a piece must not start at its second one.
    whole = F.filter(pieces, lambda piece: F.contains(col, piece))
    return F.when(F.rlike(col, F.lit(SUPPLEMENTARY)), whole).otherwise(pieces)


def _unfold(df: DataFrame, column: str, other: DataFrame, other_column: str, keep, name: str, few: bool = False) -> DataFrame:
    """Rows ``(*keep, name)``: pieces of a column, among them each that is equal to a text on the other side."""
    texts = other.select(F.col(other_column).alias("_needle")).where(F.length("_needle") > 0).distinct()
    # Texts too short for a gram have one length or two, and as many pieces as there are places.
    short = texts.where(F.length("_needle") < GRAMS[0])
    lengths = short.agg(F.array_sort(F.collect_set(F.length("_needle")))).scalar()
    parts = df.withColumn("_lengths", lengths).select(
        *keep, substrings(F.col(column), F.col("_lengths")).alias("_parts")
    )
    # The outer form keeps the optimizer from computing the list once more as a filter
    # on its size; its null rows meet nothing in the join.
    brief = parts.select(*keep, F.explode_outer("_parts").alias(name))
    return shuffled(brief.union(pieces_like(df, column, texts, "_needle", keep, name, few=few)))


def lookup(
    df: DataFrame,
    text: str,
    dictionary: Mapping | DataFrame,
    target: str = "key",
    nested: bool = False,
) -> DataFrame:
    """Key of the first entry whose value contains the text or is contained in it.

    ``dictionary`` maps keys to a text, or to a list of texts with ``nested``; or
    it is a table ``(ord, key, val)``, a nested one having one row per value; an
    ``ord`` belongs to one key.  The order of entries decides.  An empty text matches the first entry; without any
    match, and for a null text, the result is null.
    """
    if not isinstance(dictionary, DataFrame):
        entries = _entries(dictionary, nested)
        if len(entries) <= INLINE_LIMIT:
            return df.withColumn(target, _inline(F.col(text), entries))
        dictionary = df.sparkSession.createDataFrame(entries, "ord long, key string, val string")
    # One row per different text: a frequent text is searched once.  Matches carry its digest.
    keyed = df.withColumn("_digest", _digest(F.col(text)))
    texts = df.select(F.col(text).alias("s")).distinct().withColumn("digest", _digest(F.col("s")))
    return _attach(keyed, "_digest", _first_entries(texts, dictionary), target).drop("_digest")


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _inline(s: Column, entries) -> Column:
    chain = None
    for _, key, value in entries:
        if value is None:
            continue
        test = F.contains(F.lit(value), s) | F.contains(s, F.lit(value))
        chain = F.when(test, F.lit(key)) if chain is None else chain.when(test, F.lit(key))
    return F.lit(None).cast("string") if chain is None else chain


def _first_entries(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``(s, key)`` for every text with a match, ``s`` being its digest; ``texts`` holds distinct ``(s, digest)``."""
    # Only the numbers of the entries are aggregated, the keys come in at the end.
    first = F.min("ord").alias("ord")
    usable = dictionary.where(F.col("val").isNotNull())
    values = usable.groupBy("val").agg(first)

    # Text inside a value: the first entry of each piece is found beforehand.
    parts = _unfold(values, "val", texts, "s", ["ord"], "s")
    in_value = shuffled(texts).join(parts.groupBy("s").agg(first), "s").select("digest", "ord")

    # Value inside a text.
    in_text = _unfold(texts, "s", values, "val", ["digest"], "val").join(values, "val").select("digest", "ord")

    # The empty text is inside every value, an empty value inside every text.
    anyway = texts.withColumns({
        "any": usable.agg(first).scalar(),
        "blank": usable.where(F.col("val") == "").agg(first).scalar(),
    })
    always = F.least(F.when(F.col("s") == "", F.col("any")), F.when(F.col("s").isNotNull(), F.col("blank")))
    found = in_value.unionByName(in_text).unionByName(anyway.select("digest", always.alias("ord")))
    keys = usable.select("ord", "key").distinct()
    return found.groupBy("digest").agg(first).join(shuffled(keys), "ord").select(F.col("digest").alias("s"), "key")


def _attach(df: DataFrame, text: str, results: DataFrame, target: str, counted: bool = False) -> DataFrame:
    """Join results ``(s, key)`` back to all rows, spreading the rows of a frequent text.

    A salt taken from the whole row splits one text over several partitions; the
    results, one short row per text, are repeated for each salt.  Rows that are
    equal throughout share a salt; adaptive execution splits those at run time.  If texts are ``counted``, only those of
    FREQUENT_ROWS rows or more, and null ones, have salts: there are few, and results of the others come once.
    """
    of_row = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int")
    salted, last = df.withColumn("_salt", of_row), F.lit(SALTS - 1)
    if counted:
        frequent = F.broadcast(df.groupBy(F.col(text).alias("_often")).agg(F.count(F.lit(1)).alias("_n")).where(
            F.col("_often").isNotNull() & (F.col("_n") >= FREQUENT_ROWS)).select("_often"))
        spread_out = F.col("_often").isNotNull() | F.col(text).isNull()
        salted = salted.join(frequent, F.col(text) == F.col("_often"), "left").withColumn(
            "_salt", F.when(spread_out, F.col("_salt")).otherwise(0)).drop("_often")
        results = results.join(frequent, F.col("s") == F.col("_often"), "left")
        last = F.when(F.col("_often").isNotNull(), SALTS - 1).otherwise(0)
    repeated = results.select(
        F.col("s").alias("_s"), F.col("key").alias("_key"), F.explode(F.sequence(F.lit(0), last)).alias("_other_salt")
    )
    joined = salted.join(
        shuffled(repeated), (F.col(text) == F.col("_s")) & (F.col("_salt") == F.col("_other_salt")), "left"
    )
    # A column of the same name is replaced where it is.
    columns = df.columns if target in df.columns else [*df.columns, target]
    return joined.select(*[F.col("_key" if c == target else c).alias(c) for c in columns])


def keyword_lookup(
    df: DataFrame,
    text: str,
    rules: Mapping | DataFrame,
    target: str = "category",
    default: str = "unknown",
) -> DataFrame:
    """First category one of whose keywords occurs in the text, in any case.

    ``rules`` maps categories to keywords in order of priority, or is a table
    ``(priority, category, keyword)``.  Keywords are compared with the lower-cased
    text; an empty one occurs in every text.  Null texts and texts without a keyword get
    the default.
    """
    if not isinstance(rules, DataFrame):
        listed = [
            (i, name, w) for i, (name, words) in enumerate(rules.items()) for w in words if w is not None
        ]
        if len(listed) <= INLINE_LIMIT:
            low = f"_{target}_low"
            category = first_match(F.col(low), [(word, name) for _, name, word in listed], default)
            return df.withColumn(low, F.lower(F.col(text))).withColumn(target, category).drop(low)
        rules = df.sparkSession.createDataFrame(listed, "priority int, category string, keyword string")

    rule = F.min(F.struct("priority", "category")).alias("rule")
    words = rules.where(F.col("keyword").isNotNull()).groupBy("keyword").agg(rule)
    # Texts travel as a digest; only their substrings of keyword length are exchanged.
    size = words.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("keyword")).alias("characters")).first()
    # Keywords are many times less than the grams of many texts; then only what meets is exchanged.
    few = size.n <= FEW_KEYWORDS and (size.characters or 0) <= FEW_CHARACTERS and df.count() >= MANY_TEXTS
    keyed = df.withColumn("_digest", _digest(F.lower(F.col(text))))
    low = keyed.select("_digest", F.lower(F.col(text)).alias("_low"))
    hits = (
        _unfold(low, "_low", words, "keyword", ["_digest"], "keyword", few)
        .join(F.broadcast(words) if few else words, "keyword")
        .groupBy(F.col("_digest").alias("s"))
        .agg(F.min("rule").alias("rule"))
        .select("s", F.col("rule").alias("key"))
    )
    # An empty keyword is in every text, so it joins in at the end.
    blank = F.when(F.col("_digest").isNotNull(), words.where("keyword = ''").agg(F.min("rule")).scalar())
    joined = _attach(keyed, "_digest", hits, "_rule", counted=few).withColumn("_rule", F.least("_rule", blank))
    return joined.withColumn(target, F.coalesce("_rule.category", F.lit(default))).drop("_digest", "_rule")
