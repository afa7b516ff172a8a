"""Question operators: the answer to a question in, its category out.

Every operator is one column expression.  There is no shuffle and no Python worker
here, and a query that needs one category only pays for that category.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import rules as R
from ..functions import text as T


def _null() -> Column:
    return F.lit(None).cast("string")


def verdict(answer: Column) -> Column:
    """Yes / No / Other."""
    return T.let(answer, lambda a: R.first_match(a, V.VERDICT_RULES, V.VERDICT_DEFAULT))


def _vehicle(brand, model, year) -> Column:
    cells = {"brand": brand, "model": model, "year": year}
    return F.struct(*[
        (c if isinstance(c, Column) else F.lit(c).cast("string")).alias(name)
        for name, c in cells.items()
    ])


def _find_vehicle(text: Column) -> Column:
    """First rule that yields a brand; it sets brand, model and year together.

    A known phrase decides alone.  The free-text pattern also replaces a year that
    an earlier pattern found next to a blank brand.
    """

    def full(pattern: str) -> Column:
        return _vehicle(*[T.strip(T.extract(text, pattern, group)) for group in (2, 3, 1)])

    def brand_only(pattern: str) -> Column:
        return _vehicle(T.strip(T.extract(text, pattern, 2)), None, T.extract(text, pattern, 1))

    known = [(phrases, _vehicle(*cells)) for phrases, *cells in V.AV_KNOWN_PHRASES]
    patterns = (
        F.when(T.matches(text, V.AV_YEAR_BRAND_MODEL), full(V.AV_YEAR_BRAND_MODEL))
        .when(T.matches(text, V.AV_BARE_YEAR_BRAND_MODEL), full(V.AV_BARE_YEAR_BRAND_MODEL))
        .when(T.strip(T.extract(text, V.AV_YEAR_BRAND, 2)) != "", brand_only(V.AV_YEAR_BRAND))
        .when(T.matches(text, V.AV_FREE_TEXT), brand_only(V.AV_FREE_TEXT))
        .otherwise(_vehicle(None, None, None))
    )
    return R.first_match(text, known, patterns)


def _model_name(model: Column) -> Column:
    low = F.lower(model)
    named = F.when(F.contains(low, F.lit(V.MODEL_UNKNOWN_PART)), F.lit(V.UNKNOWN))
    for value, name in V.MODEL_NAMES:
        named = named.when(low == value, F.lit(name))
    return named.otherwise(model)


def _normal_vehicle(found: Column) -> Column:
    """Usual names of brand and model; ``Unknown`` for whatever is missing."""
    raw = found["brand"]
    part, part_model = V.TESLA_MODEL_IN_BRAND
    kept = F.when(R.contains_any(raw, V.NOT_A_BRAND), _null()).otherwise(raw)

    def with_brand(low: Column, brand: Column) -> Column:
        in_brand = (brand == "Tesla") & F.contains(low, F.lit(part))
        model = F.when(in_brand, F.lit(part_model)).otherwise(found["model"])
        cells = (brand, T.let(model, _model_name), found["year"])
        return _vehicle(*[R.default_if_blank(c, V.UNKNOWN) for c in cells])

    return T.let(
        F.lower(raw),
        lambda low: T.let(R.first_match(low, V.BRAND_NAMES, kept), lambda brand: with_brand(low, brand)),
    )


def automated_vehicle(answer: Column) -> Column:
    """Struct of brand, model and year, as texts; never null or empty."""
    clean = T.unify(answer, V.AV_LEAD_INS, V.AV_HEADING)
    clean = T.rewrite(clean, [(V.AV_BOLD_HEADING, V.AV_HEADING)])
    clean = T.rewrite(T.rewrite_patterns(clean, V.AV_PATTERN_REWRITES), V.AV_TEXT_REWRITES)
    return T.let(clean, lambda text: T.let(_find_vehicle(text), _normal_vehicle))


def always_null(answer: Column) -> Column:
    """The driving mode is not derived; the column is there and always null."""
    return _null()


def no_rule(answer: Column) -> Column:
    """Questions without a rule get one constant."""
    return F.lit(V.NO_RULE)


def other_road_user(answer: Column) -> Column:
    """Kind of the other road user; the captured text when no kind fits, else null."""
    clean = T.unify(answer, V.ROAD_USER_LEAD_INS, V.ROAD_USER_HEADING)
    clean = T.rewrite(clean, [(V.ROAD_USER_BOLD_HEADING, V.ROAD_USER_HEADING)])

    def kind(user: Column) -> Column:
        return T.let(F.lower(user), lambda low: R.first_match(low, V.ROAD_USER_KINDS, T.strip(user)))

    def decide(text: Column) -> Column:
        by_heading = R.first_match(text, [(V.ROAD_USER_VEHICLE_HEADINGS, V.ROAD_USER_IN_VEHICLE)])
        # An empty capture counts, a missing heading does not.
        by_kind = T.let(T.capture(text, V.ROAD_USER_PATTERN, 1), kind)
        return R.first_match(text, V.ROAD_USER_PHRASES, F.coalesce(by_kind, by_heading))

    return T.let(clean, decide)


def _find_other_vehicle(text: Column) -> Column:
    """Name of the other vehicle, ``''`` where nothing was found or only blanks."""
    full = V.OTHER_VEHICLE_YEAR_BRAND_MODEL
    brand, model = (T.strip(T.extract(text, full, group)) for group in (2, 3))
    return (
        F.when(R.contains_any(text, V.OTHER_VEHICLE_NONE_PHRASES), _null())
        .when(T.matches(text, full), T.strip(F.concat_ws(" ", brand, model)))
        .when(F.contains(text, F.lit(V.OTHER_VEHICLE_TRUCK_PHRASE)), F.lit(V.OTHER_VEHICLE_TRUCK))
        .otherwise(T.strip(T.extract(text, V.OTHER_VEHICLE_FREE_TEXT, 2)))
    )


def other_vehicle(answer: Column) -> Column:
    """Name of the other vehicle; null when there is none, ``''`` when only a cut-off tail was given."""
    clean = T.unify(answer, V.OTHER_VEHICLE_LEAD_INS, V.OTHER_VEHICLE_HEADING)
    clean = T.rewrite(clean, V.OTHER_VEHICLE_TEXT_REWRITES)
    meanings = [(V.OTHER_VEHICLE_MEANS_UNKNOWN, V.UNKNOWN), (V.OTHER_VEHICLE_MEANS_NULL, None)]
    value = T.let(T.let(clean, _find_other_vehicle), lambda name: R.exact_map(name, meanings))
    for marker, ending in V.OTHER_VEHICLE_CUTS:
        value = T.cut_tail(value, marker, ending)
    return value


def environment(answer: Column) -> Column:
    """Struct of the labelled conditions."""
    return F.struct(*[T.labelled_field(answer, label).alias(name) for name, label in V.ENVIRONMENT_LABELS])


def _severity(description: Column) -> Column:
    rules = [(words, name) for name, words in V.DAMAGE_CATEGORIES.items()]
    return T.let(F.lower(description), lambda low: R.first_match(low, rules, V.DAMAGE_DEFAULT))


def _injuries(text: Column) -> Column:
    return T.presence_flag(
        T.matches(text, V.INJURY_PATTERN, "Uid") & ~T.matches(text, V.NO_INJURY_PATTERN, "Uid"),
        F.contains(F.lower(text), F.lit(V.NO_INJURIES_TEXT)),
    )


def damage(answer: Column) -> Column:
    """Struct of collision type, damage severity and descriptions, injury flag."""
    damages = T.labelled_field(answer, V.DAMAGE_LABEL, stop="*")
    av = T.strip(T.capture(damages, V.AV_DAMAGE_PATTERN, 2, "Uid"))
    return F.struct(
        T.labelled_field(answer, V.COLLISION_LABEL).alias("collision_type"),
        _severity(av).alias("av_damage_category"),
        av.alias("av_damage_description"),
        T.strip(T.capture(damages, V.OTHER_DAMAGE_PATTERN, 2, "Uid")).alias("other_vehicle_damage"),
        T.let(T.labelled_field(answer, V.INJURIES_LABEL, stop="*"), _injuries).alias("injuries"),
    )


def _at_fault(answer: Column) -> Column:
    # The plain text test spares most rows the two backtracking searches.
    return F.when(
        F.contains(F.lower(answer), F.lit(V.FAULT_TEXT)),
        T.presence_flag(
            T.matches(answer, V.AV_FAULT_PATTERN, "Uid"),
            T.matches(answer, V.OTHER_FAULT_PATTERN, "Uid"),
        ),
    )


def responsibility(answer: Column) -> Column:
    """Struct of the at-fault flag and the contributing factors (``[]`` when none)."""
    quoted = T.split_keep(T.capture(answer, V.FACTORS_QUOTED_PATTERN, 1))
    plain = T.split_list(T.strip(T.capture(answer, V.FACTORS_PLAIN_PATTERN, 1)))
    factors = F.coalesce(quoted, plain, F.array().cast("array<string>"))
    return F.struct(
        T.let(answer, _at_fault).alias("av_at_fault"), factors.alias("contributing_factors")
    )


def behaviour(answer: Column) -> Column:
    """Struct of traffic, movements, and the same-direction and same-lane flags."""
    return F.struct(
        T.labelled_field(answer, V.TRAFFIC_LABEL).alias("traffic_conditions"),
        T.strip(T.capture(answer, V.AV_MOVEMENT_PATTERN, 2, "Uid")).alias("av_movement"),
        T.strip(T.capture(answer, V.OTHER_MOVEMENT_PATTERN, 2, "Uid")).alias("other_road_user_movement"),
        T.choice_flag(T.capture(answer, V.DIRECTION_PATTERN, 1, "Uid"), "same").alias("same_direction"),
        T.choice_flag(T.capture(answer, V.LANE_PATTERN, 1, "Uid"), "same").alias("same_lane"),
    )


OPERATORS = {
    "q1": verdict,
    "q2-av": automated_vehicle,
    "q2-av_mode": always_null,
    "q2-other_road_user": other_road_user,
    "q2-other_vehicle": other_vehicle,
    "q3": no_rule,
    "q4": environment,
    "q5": damage,
    "q6": responsibility,
    "q7": behaviour,
}
# Questions whose fields become columns of their own, ``<target>_<field>``.
SPREAD_FIELDS = {"q2-av": ("brand", "model", "year")}


def category(answer: Column, question: str) -> Column:
    """Category of an answer; a question nobody knows gets the constant."""
    return OPERATORS.get(question, no_rule)(T.text_or_empty(answer))


def categorise_all(df: DataFrame, requests: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Add the categories of several ``(question, source, target)``."""
    requests = list(requests)
    df = df.withColumns({target: category(F.col(source), q) for q, source, target in requests})
    for question, _, target in requests:
        if question in SPREAD_FIELDS:
            fields = {f"{target}_{f}": F.col(f"{target}.{f}") for f in SPREAD_FIELDS[question]}
            df = df.withColumns(fields).drop(target)
    return df


def categorise(df: DataFrame, question: str, source: str, target: str) -> DataFrame:
    """Add the category of one question."""
    return categorise_all(df, [(question, source, target)])
