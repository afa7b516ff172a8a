"""SQL (DuckDB, RE2 patterns) that derives the question columns independently."""

from __future__ import annotations

from reportweave.functions import fixed_values as V

from .responses import LINEITEM, ORDERS

BLANKS = "(chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')"


def quote(text: str | None) -> str:
    return "null::varchar" if text is None else "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def extract(x: str, pattern: str, group: int) -> str:
    return f"regexp_extract({x}, {quote(pattern)}, {group})"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {quote(pattern)})"


def holds(x: str, parts) -> str:
    parts = [parts] if isinstance(parts, str) else parts
    return "(" + " or ".join(f"position({quote(p)} in {x}) > 0" for p in parts) + ")"


def replace_all(x: str, pairs) -> str:
    for old, new in pairs:
        x = f"replace({x}, {quote(old)}, {quote(new)})"
    return x


def cases(branches, default: str = "null::varchar") -> str:
    body = " ".join(f"when {test} then {value}" for test, value in branches)
    return f"(case {body} else {default} end)"


def literal_pattern(phrases) -> str:
    special = ".*+?()[]{}|^$"
    return "|".join("".join("\\" + ch if ch in special else ch for ch in p) for p in phrases)


def responses_cte(table: str) -> str:
    report, response = {"orders": ORDERS, "lineitem": LINEITEM}[table]
    return f"responses as (select {report}, {response} from {table})"


def answers_cte() -> str:
    columns = ", ".join(
        strip(extract(
            "coalesce(response, '')",
            rf"(?s)Q{n}[^*]*?[.:](.*?)(?:\n(?:\*\*|)Q{n + 1}|$)", 1,
        )) + f" as q{n}"
        for n in V.QUESTIONS
    )
    return f"answers as (select report, response, {columns} from responses)"


def _q1() -> str:
    return cases([(holds("q1", parts), quote(label)) for parts, label in V.VERDICT_RULES],
                 quote(V.VERDICT_DEFAULT))


AV_RULE_PATTERNS = [V.AV_YEAR_BRAND_MODEL, V.AV_BARE_YEAR_BRAND_MODEL, V.AV_YEAR_BRAND, V.AV_FREE_TEXT]


def av_ctes() -> list[str]:
    heading = quote(V.AV_HEADING)
    text = f"regexp_replace(q2, {quote(literal_pattern(V.AV_LEAD_INS))}, {heading}, 'g')"
    text = f"replace({text}, {quote(V.AV_BOLD_HEADING)}, {heading})"
    for pattern, new in V.AV_PATTERN_REWRITES:
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(new)}, 'g')"
    text = replace_all(text, V.AV_TEXT_REWRITES)

    n_known = len(V.AV_KNOWN_PHRASES)
    rule = [(holds("t", phrases), str(i)) for i, (phrases, *_) in enumerate(V.AV_KNOWN_PHRASES)]
    for i, pattern in enumerate(AV_RULE_PATTERNS):
        test = matches("t", pattern)
        if pattern == V.AV_YEAR_BRAND:
            test += f" and {strip(extract('t', pattern, 2))} <> ''"
        rule.append((test, str(n_known + i)))

    def column(position: int, group: int) -> str:
        known = [(f"rule = {i}", quote(row[position])) for i, row in enumerate(V.AV_KNOWN_PHRASES)]
        found = [
            (f"rule = {n_known + i}", strip(extract("t", pattern, group)))
            for i, pattern in enumerate(AV_RULE_PATTERNS)
            if group < 3 or i < 2
        ]
        return cases(known + found)

    brand = cases(
        [(matches("lower(brand0)", "|".join(parts)), quote(name)) for parts, name in V.BRAND_NAMES]
        + [(holds("brand0", V.NOT_A_BRAND), "null::varchar")],
        "brand0",
    )
    part, part_model = V.TESLA_MODEL_IN_BRAND
    model = cases([(f"brand1 = 'Tesla' and {holds('lower(brand0)', part)}", quote(part_model))], "model0")
    model2 = cases(
        [(holds("lower(model1)", V.MODEL_UNKNOWN_PART), quote(V.UNKNOWN))]
        + [(f"lower(model1) = {quote(a)}", quote(b)) for a, b in V.MODEL_NAMES],
        "model1",
    )
    unknown = quote(V.UNKNOWN)
    return [
        f"av0 as (select report, {text} as t from answers)",
        f"av1 as (select report, t, {cases(rule, '-1')} as rule from av0)",
        f"av2 as (select report, {column(1, 2)} as brand0, {column(2, 3)} as model0,"
        f" {column(3, 1)} as year0 from av1)",
        f"av3 as (select *, {brand} as brand1 from av2)",
        f"av4 as (select *, {model} as model1 from av3)",
        f"av as (select report, coalesce(nullif(brand1, ''), {unknown}) as q2_av_brand,"
        f" coalesce(nullif({model2}, ''), {unknown}) as q2_av_model,"
        f" coalesce(nullif(year0, ''), {unknown}) as q2_av_year from av4)",
    ]


def road_user_ctes() -> list[str]:
    text = (
        f"regexp_replace(q2, {quote(literal_pattern(V.ROAD_USER_LEAD_INS))},"
        f" {quote(V.ROAD_USER_HEADING)}, 'g')"
    )
    text = replace_all(text, [(V.ROAD_USER_BOLD_HEADING, V.ROAD_USER_HEADING)])
    seen = matches("t", V.ROAD_USER_PATTERN)
    branches = [(holds("t", parts), quote(kind)) for parts, kind in V.ROAD_USER_PHRASES]
    branches += [
        (f"seen and {matches('lower(u)', '|'.join(parts))}", quote(kind))
        for parts, kind in V.ROAD_USER_KINDS
    ]
    branches += [
        ("seen", strip("u")),
        (holds("t", V.ROAD_USER_VEHICLE_HEADINGS), quote(V.ROAD_USER_IN_VEHICLE)),
    ]
    return [
        f"ru0 as (select report, {text} as t from answers)",
        f"ru1 as (select report, t, {seen} as seen, {extract('t', V.ROAD_USER_PATTERN, 1)} as u from ru0)",
        f"ru as (select report, {cases(branches)} as q2_other_road_user from ru1)",
    ]


def vehicle_ctes() -> list[str]:
    text = (
        f"regexp_replace(q2, {quote(literal_pattern(V.OTHER_VEHICLE_LEAD_INS))},"
        f" {quote(V.OTHER_VEHICLE_HEADING)}, 'g')"
    )
    text = replace_all(text, V.OTHER_VEHICLE_TEXT_REWRITES)
    full = V.OTHER_VEHICLE_YEAR_BRAND_MODEL
    named = cases(
        [
            (holds("t", V.OTHER_VEHICLE_NONE_PHRASES), "null::varchar"),
            (matches("t", full),
             strip(f"{extract('t', full, 2)} || ' ' || {strip(extract('t', full, 3))}")),
            (holds("t", V.OTHER_VEHICLE_TRUCK_PHRASE), quote(V.OTHER_VEHICLE_TRUCK)),
            (matches("t", V.OTHER_VEHICLE_FREE_TEXT), strip(extract("t", V.OTHER_VEHICLE_FREE_TEXT, 2))),
        ]
    )
    listed = ", ".join(quote(v) for v in V.OTHER_VEHICLE_MEANS_UNKNOWN)
    nothing = ", ".join(quote(v) for v in V.OTHER_VEHICLE_MEANS_NULL)
    value = cases([(f"v in ({listed})", quote(V.UNKNOWN)), (f"v in ({nothing})", "null::varchar")], "v")
    for marker, ending in V.OTHER_VEHICLE_CUTS:
        value = strip(f"regexp_replace({value}, {quote('(?s)' + marker + '.*')}, {quote(ending)})")
    return [
        f"ov0 as (select report, {text} as t from answers)",
        f"ov1 as (select report, {named} as v from ov0)",
        f"ov as (select report, {value} as q2_other_vehicle from ov1)",
    ]


def labelled(x: str, label: str, stop: str = r"*\n.") -> str:
    return strip(f"nullif({extract(x, rf'\*\*{label}:\*\*\s*([^{stop}]+)', 1)}, '')")


def q4_columns() -> dict[str, str]:
    return {f"q4_{name}": labelled("q4", label) for name, label in V.ENVIRONMENT_LABELS}


def q5_columns() -> dict[str, str]:
    damage = labelled("q5", V.DAMAGE_LABEL, "*")
    av = strip(f"nullif({extract(damage, '(?i)' + V.AV_DAMAGE_PATTERN, 2)}, '')")
    other = strip(f"nullif({extract(damage, '(?i)' + V.OTHER_DAMAGE_PATTERN, 2)}, '')")
    hurt = labelled("q5", V.INJURIES_LABEL, "*")
    severity = cases(
        [(matches(f"lower({av})", "|".join(words)), quote(name))
         for name, words in V.DAMAGE_CATEGORIES.items()],
        quote(V.DAMAGE_DEFAULT),
    )
    injured = matches(hurt, "(?i)" + V.INJURY_PATTERN)
    denied = matches(hurt, "(?i)" + V.NO_INJURY_PATTERN)
    return {
        "q5_collision_type": labelled("q5", V.COLLISION_LABEL),
        "q5_av_damage_category": severity,
        "q5_av_damage_description": av,
        "q5_other_vehicle_damage": other,
        "q5_injuries": cases(
            [(f"{injured} and not {denied}", "true"),
             (f"{matches(f'lower({hurt})', V.NO_INJURIES_TEXT)}", "false")],
            "null::boolean",
        ),
    }


def q6_columns() -> dict[str, str]:
    quoted = extract("q6", V.FACTORS_QUOTED_PATTERN, 1)
    plain = strip(extract("q6", V.FACTORS_PLAIN_PATTERN, 1))
    factors = cases(
        [
            (matches("q6", V.FACTORS_QUOTED_PATTERN),
             f"list_transform(string_split({quoted}, ','), lambda p: {strip('p')})"),
            (matches("q6", V.FACTORS_PLAIN_PATTERN),
             f"list_filter(list_transform(string_split_regex({plain}, {quote(V.FACTORS_SEPARATORS)}),"
             f" lambda p: {strip('p')}), lambda p: p <> '')"),
        ],
        "[]::varchar[]",
    )
    return {
        "q6_av_at_fault": cases(
            [(matches("q6", "(?i)" + V.AV_FAULT_PATTERN), "true"),
             (matches("q6", "(?i)" + V.OTHER_FAULT_PATTERN), "false")],
            "null::boolean",
        ),
        "q6_contributing_factors": factors,
    }


def q7_columns() -> dict[str, str]:
    def choice(pattern: str) -> str:
        return f"(nullif(lower({extract('q7', '(?i)' + pattern, 1)}), '') = 'same')"

    def movement(pattern: str) -> str:
        return strip(f"nullif({extract('q7', '(?i)' + pattern, 2)}, '')")

    return {
        "q7_traffic_conditions": labelled("q7", V.TRAFFIC_LABEL),
        "q7_av_movement": movement(V.AV_MOVEMENT_PATTERN),
        "q7_other_road_user_movement": movement(V.OTHER_MOVEMENT_PATTERN),
        "q7_same_direction": choice(V.DIRECTION_PATTERN),
        "q7_same_lane": choice(V.LANE_PATTERN),
    }


def with_clause(table: str = "orders", *parts: list[str]) -> str:
    ctes = [responses_cte(table), answers_cte()]
    for part in parts:
        ctes += part
    return "with " + ",\n".join(ctes) + "\n"


def columns_sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{x} as {name}" for name, x in columns.items())


def structured_ctes() -> list[str]:
    """All category columns, flat and with lists joined; one row per response.

    Reports are unique in ``orders``, so the parts can be joined by report.
    """
    rest = {"q1_category": _q1(), "q3_category": quote(V.NO_RULE), "q2_av_mode": "null::varchar"}
    for part in (q4_columns(), q5_columns(), q6_columns(), q7_columns()):
        rest.update(part)
    return av_ctes() + road_user_ctes() + vehicle_ctes() + [
        f"rest as (select *, {columns_sql(rest)} from answers)",
        "structured as (select rest.*, q2_av_brand, q2_av_model, q2_av_year, q2_other_road_user,"
        " q2_other_vehicle from rest join av using (report) join ru using (report)"
        " join ov using (report))",
    ]


def q1_column() -> str:
    return _q1()
