"""Text functions and rules against golden rows."""

import random

from pyspark.sql import functions as F

from reportweave.functions import rules as R
from reportweave.functions import text as T


def evaluate(spark, values, column):
    """Apply a column expression over ``c`` to a list of texts, keeping their order."""
    df = spark.createDataFrame(list(enumerate(values)), "i int, c string")
    return [r.x for r in df.select("i", column(F.col("c")).alias("x")).orderBy("i").collect()]


ANSWERS = [
    ("**Q1.** Yes, the car was.\n**Q2.** Foo", 1, "** Yes, the car was."),
    ("Q1: No.\nQ2: x", 1, "No."),
    ("**Q1** Yes.\nQ2: x", 1, ""),
    ("Q2: a\nQ4: b", 2, "a\nQ4: b"),
    ("Q2: a\nQ4: b", 3, ""),
    ("Q10: foo", 1, "foo"),
    ("Q7: slow\nQ8: extra", 7, "slow"),
    (None, 4, ""),
    ("Q1. one\n\n**Q2. two\nlines**\n", 2, "two\nlines**"),
    ("Q1: a Q2: b", 1, "a Q2: b"),
    ("Q1:\nQ2: b", 1, ""),
    ("Q1.\xa0 x  \nQ2", 1, "x"),
]


def test_extract_answer(spark):
    for question in {q for _, q, _ in ANSWERS}:
        golden = [(r, e) for r, q, e in ANSWERS if q == question]
        assert evaluate(spark, [r for r, _ in golden], lambda c: T.extract_answer(c, question)) == [
            e for _, e in golden
        ]


def answer_by_search(response, question):
    """The same answer found by plain text search instead of a pattern."""
    start = 0
    while (at := response.find(f"Q{question}", start)) >= 0:
        rest = response[at + 2:]
        stops = [p for p in (rest.find("."), rest.find(":")) if p >= 0]
        star = rest.find("*")
        if stops and (star < 0 or min(stops) < star):
            body = rest[min(stops) + 1:]
            ends = [e for e in (body.find(f"\nQ{question + 1}"), body.find(f"\n**Q{question + 1}")) if e >= 0]
            return body[: min(ends)].strip() if ends else body.strip()
        start = at + 1
    return ""


def test_extract_answer_on_random_texts(spark):
    rng = random.Random(7)
    pieces = ["Q1", "Q2", "Q3", "\n", "*", "**", ".", ":", " ", "a", "b\xa0", " ", "\r", "\x1c"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    for question in (1, 2):
        assert evaluate(spark, texts, lambda c: T.extract_answer(c, question)) == [
            answer_by_search(t, question) for t in texts
        ]


def test_long_answers(spark):
    long = "a b\n" * 300_000
    got = evaluate(spark, [f"Q1. {long}\nQ2: {long}x"], lambda c: T.extract_answer(c, 1))
    assert got == [long.strip()]
    field = evaluate(spark, [f"**X:** {'y ' * 300_000}* z"], lambda c: T.labelled_field(c, "X", "*"))
    assert field == [("y " * 300_000).strip()]


def test_strip_matches_python(spark):
    texts = ["", " a ", "\n\ta b\r\n", "　x ", "\x1cy\x1f", "​z", "\x85w\xa0", "   "]
    assert evaluate(spark, texts, T.strip) == [t.strip() for t in texts]


def test_labelled_field(spark):
    short = ["**Weather:** Clear. x", "**Weather:** .", "**Weather:**\n\n Rain* y", "**Weather:**\xa0\n Fog\nx", "Weather: Clear"]
    assert evaluate(spark, short, lambda c: T.labelled_field(c, "Weather")) == ["Clear", "", "Rain", "Fog", None]
    long = ["**Weather:** a. b\nc* d", "**Weather:***", None]
    assert evaluate(spark, long, lambda c: T.labelled_field(c, "Weather", "*")) == ["a. b\nc", None, None]


def test_splits(spark):
    assert evaluate(spark, ["a,, b", "", " x "], T.split_keep) == [["a", "", "b"], [""], ["x"]]
    texts = ["speed, weather and glare", ";and ,", "sandy and; band", "\xe9and x", ""]
    assert evaluate(spark, texts, T.split_list) == [
        ["speed", "weather", "glare"], [], ["sandy", "band"], ["\xe9and x"], []
    ]


def test_cut_tail(spark):
    assert evaluate(spark, ["Ford truck\nred", "van", None], lambda c: T.cut_tail(c, "truck")) == ["Ford", "van", None]
    assert evaluate(spark, ["x A Toyota y\nz"], lambda c: T.cut_tail(c, "A Toyota", "Toyota")) == ["x Toyota"]


def test_pretty_label(spark):
    texts = ["not_in LANE", "", None, "x", "_a"]
    assert evaluate(spark, texts, T.pretty_label) == ["Not in lane", "", None, "X", " a"]


def test_slugify(spark):
    assert evaluate(spark, ["  Été: Q1 -- Hist_1 ", "_-x-_", "ﬁn ½", None], T.slugify) == [
        "ete-q1-hist_1", "x", "fin-12", None
    ]
    assert evaluate(spark, ["Été x"], lambda c: T.slugify(c, allow_unicode=True)) == ["été-x"]


def test_file_names(spark):
    paths = ["/a/b/report.1.pdf", "x.pdf", "/a/.hidden", "..a", "dir/", "plain"]
    assert evaluate(spark, paths, T.file_stem) == ["report.1", "x", ".hidden", "..a", "", "plain"]
    assert evaluate(spark, paths, T.file_name)[0] == "report.1.pdf"


def test_rewrite_keeps_order(spark):
    pairs = [("Model:", "Model"), ("Brand:", "Brand"), ("Model:", "Model")]
    assert evaluate(spark, ["Model:: Brand:"], lambda c: T.rewrite(c, pairs)) == ["Model Brand"]
    pairs = [("a.b", "$1"), ("(x)", "\\"), (" - ", "")]
    assert evaluate(spark, ["a.b acb (x) - y"], lambda c: T.rewrite(c, pairs)) == ["$1 acb \\y"]


def test_rules(spark):
    rules = [(["a", "b"], "first"), ("c", "second")]
    assert evaluate(spark, ["xb", "c", "z", None], lambda c: R.first_match(c, rules, "none")) == [
        "first", "second", "none", "none"
    ]
    words = {"minor": ["slight"], "major": ["dent", "heavy"]}
    assert evaluate(spark, ["a DENT", "Slight dent", "x", None], lambda c: R.keyword_category(c, words)) == [
        "major", "minor", "unknown", "unknown"
    ]
    mapping = [(["None", ""], None), (["?"], "Unknown")]
    assert evaluate(spark, ["None", "", "?", "x", None], lambda c: R.exact_map(c, mapping)) == [
        None, None, "Unknown", "x", None
    ]
    assert evaluate(spark, ["", None, "x"], lambda c: R.default_if_blank(c, "d")) == ["d", "d", "x"]


def test_letters_of_several_and_combining_marks(spark):
    rows = spark.createDataFrame([("ßa",), ("ﬁx",), ("ǆ_B",), ("plain_Text",), ("हिन्दी",)], "v string")
    got = [tuple(r) for r in rows.select(T.pretty_label(F.col("v")), T.slugify(F.col("v"), allow_unicode=True)).collect()]
    assert [g[0] for g in got[:4]] == ["Ssa", "Fix", "ǅ b", "Plain text"]
    assert got[4][1] == "हनद"
