"""Lookups: the inline and the join form against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from reportweave.operators import lookup as L
from reportweave.operators.grams import pieces_like


def search(entries, text):
    """First entry that contains the text or is contained in it."""
    if text is None:
        return None
    return next((k for _, k, v in sorted(entries) if v is not None and (text in v or v in text)), None)


def found(df):
    return {r.i: r.key for r in df.select("i", "key").collect()}


@pytest.fixture(params=["inline", "join"])
def form(request, monkeypatch):
    if request.param == "join":
        monkeypatch.setattr(L, "INLINE_LIMIT", 0)
    return request.param


def as_given(spark, form, entries, schema):
    """Entries as a mapping, or as a table where the join is tested."""
    if form == "join":
        return spark.createDataFrame(entries, schema)
    grouped = {}
    for _, key, value in sorted(entries, key=lambda e: e[0]):
        grouped.setdefault(key, []).append(value)
    return grouped


def texts_table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)


def test_golden_rows(spark, form):
    df = texts_table(spark, ["Ford", "A Ford van", "", "Kia", None])
    got = found(L.lookup(df, "t", {"a": "Ford Focus", "b": "Ford"}))
    assert got == {0: "a", 1: "b", 2: "a", 3: None, 4: None}
    nested = found(L.lookup(df, "t", {"x": ["Opel", "van"], "y": ["Ford Focus", "Ka"]}, nested=True))
    assert nested == {0: "y", 1: "x", 2: "x", 3: None, 4: None}


@pytest.mark.parametrize("frequent", [1, 5, 10_000])
def test_pieces_hold_every_needle(spark, frequent):
    """Grams of either length, also where most are frequent, and code points beyond the first plane."""
    rng = random.Random(12)

    def word(low, high):
        return "".join(rng.choice("ab\U0001F600\U0001F601 é\n") for _ in range(rng.randint(low, high)))

    texts = [word(0, 40) for _ in range(60)] + [None, "", "ab"]
    needles = [t[i : i + rng.randint(3, 20)] for t in texts if t for i in (rng.randrange(len(t)),)] + [word(3, 9) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    others = spark.createDataFrame([(n,) for n in needles] + [(None,)], "n string")
    pieces = {(r.i, r.p) for r in pieces_like(rows, "t", others, "n", ["i"], "p", frequent=frequent).collect()}
    for i, t in enumerate(texts):
        for n in needles:
            if t and len(n) >= 3:
                assert ((i, n) in pieces) == (n in t)
    assert all(p is None or p in texts[i] for i, p in pieces)


def test_pieces_do_not_grow_with_the_number_of_needles(spark):
    """Needles of one shape cost what one of them costs."""
    rows = spark.createDataFrame([(0, "x" * 50 + "qqq" + "y" * 50)], "i int, t string")
    few, many = (spark.createDataFrame([("qqq" + f"{n:03}",) for n in range(k)] + [("qqqyyy",)], "n string") for k in (1, 500))
    counts = [pieces_like(rows, "t", needles, "n", ["i"], "p").count() for needles in (few, many)]
    assert counts[0] == counts[1] == 1


def test_random_lookup(spark, form):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("aé b") for _ in range(rng.randint(0, n)))
    texts = [word(7) for _ in range(150)] + ["ab"] * 60 + [None, ""]
    entries = [(i, f"k{i % 17}", word(9)[rng.randint(0, 1):] or "zz") for i in range(60)] + [(60, "null", None)]
    rng.shuffle(entries)
    df = texts_table(spark, texts)
    dictionary = spark.createDataFrame(entries, "ord long, key string, val string")
    assert found(L.lookup(df, "t", dictionary)) == {i: search(entries, t) for i, t in enumerate(texts)}


def test_empty_value_is_inside_every_text(spark, form):
    entries = [(0, "first", "abc"), (1, "blank", ""), (2, "later", "x")]
    df = texts_table(spark, ["x", "b", "", None])
    dictionary = spark.createDataFrame(entries, "ord long, key string, val string")
    assert found(L.lookup(df, "t", dictionary)) == {0: "blank", 1: "first", 2: "first", 3: None}


def test_empty_dictionary(spark, form):
    df = texts_table(spark, ["x", ""])
    empty = spark.createDataFrame([], "ord long, key string, val string")
    assert found(L.lookup(df, "t", empty)) == {0: None, 1: None}


def test_join_form_pairs_nothing(spark, monkeypatch):
    """No nested loop: both sides meet on equal substrings."""
    monkeypatch.setattr(L, "INLINE_LIMIT", 0)
    df = texts_table(spark, ["x"])
    dictionary = spark.createDataFrame([(0, "k", "xy")], "ord long, key string, val string")
    plan = L.lookup(df, "t", dictionary)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_keywords(spark, form):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abÉc ") for _ in range(n))
    rules = {f"c{i}": [word(rng.randint(1, 4)).lower() for _ in range(3)] for i in range(8)}
    texts = [word(rng.randint(0, 14)) for _ in range(120)] + ["abcabc"] * 40 + [None, ""]
    df = texts_table(spark, texts)

    def want(text):
        low = (text or "").lower()
        return next((c for c, words in rules.items() if any(w in low for w in words)), "none")

    got = L.keyword_lookup(df, "t", rules, target="key", default="none")
    assert found(got) == {i: want(t) for i, t in enumerate(texts)}


def test_other_columns_survive(spark, form):
    df = texts_table(spark, ["Ford"]).withColumn("m", F.lit(1.5))
    assert L.lookup(df, "t", {"a": "Ford"}, target="hit").columns == ["i", "t", "m", "hit"]
    assert L.keyword_lookup(df, "t", {"a": ["f"]}, target="hit").columns == ["i", "t", "m", "hit"]


def test_edge_cases_are_the_same_in_both_forms(spark, form):
    texts = ["\U0001f600abc", "x", "", None, "?abc", "\U0001f600"]
    df = texts_table(spark, texts).select("i", F.lit("old").alias("key"), "t")
    entries = [(0, "a", None), (1, "b", "?abc"), (2, "c", "\U0001f600ab"), (3, "d", "x")]
    got = L.lookup(df, "t", as_given(spark, form, entries, "ord long, key string, val string"), nested=True)
    assert got.columns == ["i", "key", "t"]
    assert found(got) == {i: search(entries, t) for i, t in enumerate(texts)}
    for rules in ([(0, "q", "?abc"), (1, "all", ""), (2, "x", "x")], [(0, "x", "x"), (1, "all", ""), (2, "none", None)]):
        got = L.keyword_lookup(df, "t", as_given(spark, form, rules, "priority int, category string, keyword string"), target="key")
        assert got.columns == ["i", "key", "t"]
        want = {
            i: "unknown" if t is None else next(c for _, c, w in rules if w is not None and w in t) for i, t in enumerate(texts)
        }
        assert found(got) == want


def test_few_keywords_go_to_many_texts(spark, monkeypatch):
    """Keywords of all lengths, repeated and null texts: the grams of the texts are not exchanged, and the result is the same."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcé😀") for _ in range(rng.randrange(1, 14))) for _ in range(150)]
    texts = ["".join(rng.choice([*"abcABCé😀 ", rng.choice(words)]) for _ in range(rng.randrange(60))) for _ in range(200)]
    rows = [(i, text) for i, text in enumerate([*texts, *[texts[0]] * 40, "", None, None])]
    rules = [(rng.randrange(50), f"c{rng.randrange(5)}", word) for word in [*words[:120], None]]
    df = spark.createDataFrame(rows, "id int, text string")
    table = spark.createDataFrame(rules, "priority int, category string, keyword string")

    def first(text):
        met = [(p, c) for p, c, w in rules if w is not None and text is not None and w in text.lower()]
        return min(met)[1] if met else "unknown"

    for few in (False, True):
        if few:
            monkeypatch.setattr(L, "MANY_TEXTS", 1)
            monkeypatch.setattr(L, "FREQUENT_ROWS", 20)
        found = L.keyword_lookup(df, "text", table)
        assert {r.id: r.category for r in found.collect()} == {i: first(text) for i, text in rows}
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [gram" in line and "Inner" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins)
