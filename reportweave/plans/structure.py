"""From responses to the structured table, and what is read off it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import extract_answer
from ..operators.questions import categorise_all

Hook = Callable[[DataFrame], DataFrame]

# (question, answer column, category column) in the order of the output.
CATEGORY_COLUMNS = [
    ("q1", "q1", "q1_category"),
    ("q2-av", "q2", "q2_av"),
    ("q2-av_mode", "q2", "q2_av_mode"),
    ("q2-other_road_user", "q2", "q2_other_road_user"),
    ("q2-other_vehicle", "q2", "q2_other_vehicle"),
    ("q3", "q3", "q3_category"),
    ("q4", "q4", "q4_category"),
    ("q5", "q5", "q5_category"),
    ("q6", "q6", "q6_category"),
    ("q7", "q7", "q7_category"),
]

STRUCTURED_COLUMNS = [
    "q1", "q1_category",
    "q2", "q2_av_brand", "q2_av_model", "q2_av_year", "q2_av_mode",
    "q2_other_road_user", "q2_other_vehicle",
    "q3", "q3_category",
    "q4", "q4_category",
    "q5", "q5_category",
    "q6", "q6_category",
    "q7", "q7_category",
]

NESTED_FIELDS = {
    "q4_category": ["weather", "lighting_conditions", "road_surface", "road_conditions"],
    "q5_category": [
        "collision_type", "av_damage_category", "av_damage_description",
        "other_vehicle_damage", "injuries",
    ],
    "q6_category": ["av_at_fault", "contributing_factors"],
    "q7_category": [
        "traffic_conditions", "av_movement", "other_road_user_movement",
        "same_direction", "same_lane",
    ],
}


def with_answers(df: DataFrame, response: str = "response", questions=V.QUESTIONS) -> DataFrame:
    """Add one answer column ``q<n>`` per question."""
    return df.withColumns({f"q{n}": extract_answer(F.col(response), n) for n in questions})


def structure(
    responses: DataFrame,
    clean: Hook | None = None,
    keep: Hook | None = None,
    response: str = "response",
) -> DataFrame:
    """Append answers and categories to a table of responses, batch or stream.

    ``clean`` and ``keep`` are optional hooks, applied to the table before the
    answers are read, in this order.  Columns the input has already are kept in front.
    """
    df = responses
    for hook in (clean, keep):
        df = df.transform(hook) if hook else df
    front = [c for c in df.columns if c not in STRUCTURED_COLUMNS]
    df = categorise_all(with_answers(df, response), CATEGORY_COLUMNS)
    return df.select(*front, *STRUCTURED_COLUMNS)


def flatten_categories(structured: DataFrame) -> DataFrame:
    """Category structs as plain columns ``q4_weather``, ``q5_injuries`` and so on."""
    flat = [
        F.col(f"{column}.{field}").alias(f"{column.split('_')[0]}_{field}")
        for column, fields in NESTED_FIELDS.items()
        for field in fields
    ]
    return structured.select(*[c for c in structured.columns if c not in NESTED_FIELDS], *flat)


def missing_fields() -> dict[str, Column]:
    """Tests on a structured row: a field of question 2 was not found."""
    return {
        "no_brand": F.col("q2_av_brand") == V.UNKNOWN,
        "no_model": F.col("q2_av_model") == V.UNKNOWN,
        "no_year": F.col("q2_av_year") == V.UNKNOWN,
        "no_road_user": F.col("q2_other_road_user").isNull(),
        "no_vehicle": F.coalesce(F.col("q2_other_vehicle"), F.lit("")) == "",
    }


def coverage(structured: DataFrame) -> DataFrame:
    """One row: number of rows, and rows in which a field of question 2 was not found."""
    return structured.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(test).alias(name) for name, test in missing_fields().items()],
    )


def unmatched_phrases(structured: DataFrame, answer: str = "q2", top: int = 20, longest: int = 3) -> DataFrame:
    """``(field, rank, phrase, n)``: what the answers say most often where a field was not found.

    Phrases are one to ``longest`` neighbouring words in lower case, of letters and digits; ``n``
    answers have the phrase.  Of equal counts, the phrase that is smaller comes first.  Counts
    are exact: answers are first counted by phrase and by the set of fields they miss, so that
    an answer is not repeated for its fields.
    """
    words = F.filter(F.split(F.lower(answer), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def phrases(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("words") - n + 1)
        runs = F.transform(starts, lambda i: F.array_join(F.slice("words", i, n), " "))
        return F.when(F.size("words") >= n, runs).otherwise(F.array().cast("array<string>"))

    tests = missing_fields()
    fields = F.filter(
        F.array(*[F.when(test, F.lit(name.removeprefix("no_"))) for name, test in tests.items()]), lambda f: f.isNotNull()
    )
    missed = structured.select(fields.alias("fields"), words.alias("words")).where("size(fields) > 0 and words is not null")
    each = F.array_distinct(F.concat(*[phrases(n) for n in range(1, longest + 1)]))
    counted = missed.select("fields", F.explode(each).alias("phrase")).groupBy("fields", "phrase").agg(
        F.count(F.lit(1)).alias("n")
    )
    summed = counted.select(F.explode("fields").alias("field"), "phrase", "n").groupBy("field", "phrase").agg(
        F.sum("n").alias("n")
    )
    rank = F.row_number().over(W.partitionBy("field").orderBy(F.desc("n"), "phrase"))
    return summed.withColumn("rank", rank).where(F.col("rank") <= top).select("field", "rank", "phrase", "n")


def sorted_columns(df: DataFrame) -> DataFrame:
    """Columns in alphabetical order."""
    return df.select(*sorted(df.columns))
