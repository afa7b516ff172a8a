"""SQL for DuckDB with the same result as each registered query."""

from __future__ import annotations

from reportweave.plans.structure import STRUCTURED_COLUMNS

from . import oracle_questions as O
from .queries import DICTIONARY, KEYWORDS, NESTED_DICTIONARY

ORACLE_SQL: dict[str, str] = {}


def _hist(source: str, columns: list[str], value=lambda c: c) -> str:
    return " union all ".join(
        f"select '{c}' as variable, cast({value(c)} as varchar) as value, count(*) as n"
        f" from {source} where {c} is not null group by 2"
        for c in columns
    )


def _answers(select: str, *parts: list[str], table: str = "orders") -> str:
    return O.with_clause(table, *parts) + select


def _pretty(x: str) -> str:
    words = f"replace({x}, '_', ' ')"
    return f"upper(substr({words}, 1, 1)) || lower(substr({words}, 2))"


Q1 = [f"rows as (select report, {O.q1_column()} as q1_category from answers)"]

ORACLE_SQL["q1_category_hist"] = _answers(_hist("rows", ["q1_category"]), Q1)
ORACLE_SQL["extract_answers_all"] = _answers("select report, q1, q2, q3, q4, q5, q6, q7 from answers")
for part in ("brand", "model", "year"):
    ORACLE_SQL[f"q2_av_{part}"] = _answers(f"select report, q2_av_{part} from av", O.av_ctes())
ORACLE_SQL["q2_av_mode_null"] = _answers(
    "select cast(null as varchar) as q2_av_mode, count(*) as n from answers"
)
ORACLE_SQL["q2_other_road_user"] = _answers("select * from ru", O.road_user_ctes())
ORACLE_SQL["q2_other_vehicle"] = _answers("select * from ov", O.vehicle_ctes())
ORACLE_SQL["q3_constant"] = _answers(
    "select 'q3_category' as variable, 'Wrong question' as value, count(*) as n from answers"
)
ORACLE_SQL["q4_environment"] = _answers(
    f"select report, {O.columns_sql(O.q4_columns())} from answers", table="lineitem"
)
_q5 = O.q5_columns()
ORACLE_SQL["q5_injuries"] = _answers(
    f"select report, {_q5['q5_injuries']} as q5_injuries from answers"
)
ORACLE_SQL["q5_damage"] = _answers(
    "select report, " + O.columns_sql({k: v for k, v in _q5.items() if k != "q5_injuries"})
    + " from answers"
)
_q6 = O.q6_columns()
_factors = ["f as (select report, " + _q6["q6_contributing_factors"] + " as x, "
            + _q6["q6_av_at_fault"] + " as at_fault from answers)"]
ORACLE_SQL["q6_fault"] = _answers("select report, at_fault as q6_av_at_fault from f", _factors)
ORACLE_SQL["q6_factors"] = _answers(
    "select report, cast(len(x) as integer) as n_factors,"
    " coalesce(array_to_string(x, '|'), '') as factors from f", _factors,
)
ORACLE_SQL["q6_factor_hist"] = _answers(
    "select 'av_at_fault' as variable, cast(at_fault as varchar) as value, count(*) as n from f"
    " where at_fault is not null group by 2 union all"
    " select 'contributing_factors', value, count(*) from (select unnest(x) as value from f) group by 2",
    _factors,
)
_q7 = O.q7_columns()
ORACLE_SQL["q7_movement"] = _answers(f"select report, {O.columns_sql(_q7)} from answers")
ORACLE_SQL["hist_nested_fields"] = _answers(
    _hist("rows", [c.removeprefix("q7_") for c in _q7]),
    ["rows as (select " + O.columns_sql({k.removeprefix("q7_"): v for k, v in _q7.items()})
     + " from answers)"],
)

_flat = sorted(
    ["report", "response", *[c for c in STRUCTURED_COLUMNS
                             if c not in ("q4_category", "q5_category", "q6_category", "q7_category")],
     *O.q4_columns(), *O.q5_columns(), *O.q6_columns(), *O.q7_columns()]
)
ORACLE_SQL["structured_table"] = _answers(
    "select " + ", ".join(
        "coalesce(array_to_string(q6_contributing_factors, '|'), '') as q6_contributing_factors"
        if c == "q6_contributing_factors" else c
        for c in _flat
    ) + " from structured",
    O.structured_ctes(),
)
ORACLE_SQL["coverage_of_fields"] = _answers(
    "select count(*) as n_rows, count(*) filter (q2_av_brand = 'Unknown') as no_brand,"
    " count(*) filter (q2_av_model = 'Unknown') as no_model,"
    " count(*) filter (q2_av_year = 'Unknown') as no_year,"
    " count(*) filter (q2_other_road_user is null) as no_road_user,"
    " count(*) filter (q2_other_vehicle is null or q2_other_vehicle = '') as no_vehicle"
    " from av join ru using (report) join ov using (report)",
    O.av_ctes(), O.road_user_ctes(), O.vehicle_ctes(),
)
ORACLE_SQL["unmatched_phrases_of_fields"] = _answers(
    "select field, cast(rank as integer) as rank, phrase, n from (select *, row_number() over"
    " (partition by field order by n desc, phrase) as rank from counted) where rank <= 20",
    O.structured_ctes(),
    [
        "missed as (select report, field, list_filter(string_split_regex(lower(q2), '[^\\p{L}\\p{N}]+'),"
        " lambda w: w <> '') as words from (select report, q2, unnest(list_filter(["
        "case when q2_av_brand = 'Unknown' then 'brand' end, case when q2_av_model = 'Unknown' then 'model' end,"
        " case when q2_av_year = 'Unknown' then 'year' end,"
        " case when q2_other_road_user is null then 'road_user' end,"
        " case when coalesce(q2_other_vehicle, '') = '' then 'vehicle' end], lambda f: f is not null)) as field"
        " from structured))",
        "counted as (select field, phrase, count(*) as n from (select distinct report, field,"
        " array_to_string(words[cast(i as bigint):cast(i + k - 1 as bigint)], ' ') as phrase from missed, range(1, 4) t(k),"
        " range(1, 2000) s(i) where i + k - 1 <= len(words)) group by 1, 2)",
    ],
)
ORACLE_SQL["clean_and_keep_hooks"] = _answers(
    _hist("kept", ["q1_category", "q2_other_road_user"]),
    O.structured_ctes(),
    ["kept as (select * from structured where position('at fault' in response) > 0)"],
)
ORACLE_SQL["run_metrics"] = _answers(
    "select (select count(*) from responses) as processed,"
    " (select count(*) from responses where response is null) as without_response,"
    " (select count(*) from responses) - count(*) as dropped, count(*) as included,"
    " count(*) filter (q2_av_brand = 'Unknown') as no_brand,"
    " count(*) filter (q2_av_model = 'Unknown') as no_model,"
    " count(*) filter (q2_av_year = 'Unknown') as no_year,"
    " count(*) filter (q2_other_road_user is null) as no_road_user,"
    " count(*) filter (q2_other_vehicle is null or q2_other_vehicle = '') as no_vehicle from kept",
    O.structured_ctes(),
    ["kept as (select * from structured where position('at fault' in response) > 0)"],
)
ORACLE_SQL["unknown_question"] = _answers(
    "select 'category' as variable, 'wrong question' as value, count(*) as n from answers"
)

# --- chart tables -----------------------------------------------------------------
ORACLE_SQL["hist_color"] = (
    "select 'event_type' as variable, event_type as value, user_id as color, count(*) as n"
    " from events where event_type is not null group by 2, 3"
)
ORACLE_SQL["hist_multi"] = _answers(
    _hist("(select q1_category, q2_av_brand, q2_av_year, q2_other_road_user as q2_user from rows"
          " join av using (report) join ru using (report))",
          ["q1_category", "q2_av_brand", "q2_av_year", "q2_user"]),
    Q1, O.av_ctes(), O.road_user_ctes(),
)


def _bins(table: str, x: str, nbins: int, color: str | None = None) -> str:
    by = f", {color} as color" if color else ""
    names = ", color" if color else ""
    return f"""
        with e as (select min({x}) as lo, max({x}) as hi from {table}),
        b as (select cast(case when hi = lo then 0 else
                least(floor(({x} - lo) * {nbins} / (hi - lo)), {nbins - 1}) end as integer) as bin,
                lo, hi{by} from {table}, e where {x} is not null)
        select '{x}' as variable, bin, round(lo + bin * ((hi - lo) / {nbins}), 6) as bin_start,
               round(lo + (bin + 1) * ((hi - lo) / {nbins}), 6) as bin_end{names}, count(*) as n
        from b group by bin, lo, hi{names}"""


ORACLE_SQL["hist_binned"] = _bins("lineitem", "l_extendedprice", 25)
ORACLE_SQL["hist_binned_color"] = _bins("lineitem", "l_quantity", 7, "l_returnflag")
ORACLE_SQL["marginal_histogram"] = _bins("events", "value", 20)
ORACLE_SQL["hist_topk"] = _answers(
    "select * from (" + _hist("ov", ["q2_other_vehicle"])
    + ") order by n desc, variable, value limit 10",
    O.vehicle_ctes(),
)

_totals = (
    "with t as (select o_orderpriority as x, count(*) as n_orders,"
    " round(sum(o_totalprice), 2) as total, count(*) filter (o_orderstatus = 'F') as n_finished"
    " from orders group by 1) "
)
ORACLE_SQL["bar_table"] = _totals + (
    "select x, 0 as series_no, 'n_orders' as series, cast(n_orders as double) as value from t"
    " union all select x, 1, 'total', total from t"
)
ORACLE_SQL["bar_stacked"] = _totals + (
    "select x, 0 as series_no, 'n_orders' as series, n_orders as value, cast(0 as double) as start,"
    ' cast(n_orders as double) as "end" from t'
    " union all select x, 1, 'n_finished', n_finished, n_orders, n_orders + n_finished from t"
)
ORACLE_SQL["bar_rows"] = (
    "select p_partkey as x, 0 as series_no, 'p_size' as series, cast(p_size as double) as value,"
    ' cast(0 as double) as start, cast(p_size as double) as "end" from part'
    " union all select p_partkey, 1, 'p_retailprice', round(p_retailprice, 6), p_size,"
    " round(p_size + p_retailprice, 6) from part"
)
ORACLE_SQL["scatter_points"] = (
    f"select p_size, p_retailprice, {_pretty('p_type')} as p_type, p_brand,"
    f" {_pretty('p_name')} as p_name, p_partkey from part"
)
ORACLE_SQL["scatter_ols"] = (
    "select l_returnflag as color, count(*) as n,"
    " round(regr_slope(l_extendedprice, l_quantity), 6) as slope,"
    " round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept,"
    " round(regr_r2(l_extendedprice, l_quantity), 9) as r2 from lineitem group by 1"
)
def _lowess(points: int, reach: str, digits: int) -> str:
    """Local lines on the grid of each colour; ``reach`` is an aggregate over the distances."""
    return f"""
    with p as (select l_returnflag as color, l_quantity as x, l_extendedprice as y from lineitem),
    e as (select color, min(x) as lo, max(x) as hi from p group by color),
    d as (select color, cast(i as integer) as point, lo + i * ((hi - lo) / {points - 1}) as place, y,
            x - (lo + i * ((hi - lo) / {points - 1})) as d
          from p join e using (color), range({points}) t(i)),
    r as (select color, point, {reach} as reach from d group by 1, 2),
    w as (select color, point, place, y, d,
            case when abs(d) < reach then pow(1 - pow(abs(d) / reach, 3), 3) else 0 end as w
          from d join r using (color, point)),
    s as (select color, point, place, sum(w) as s, sum(w * d) as sd, sum(w * d * d) as sdd,
            sum(w * y) as sy, sum(w * d * y) as sdy from w group by 1, 2, 3)
    select color, point, round(place, 6) as x,
           round((sdd * sy - sd * sdy) / (s * sdd - sd * sd), {digits}) as fit from s"""


ORACLE_SQL["lowess"] = _lowess(12, "15", 4)
ORACLE_SQL["lowess_frac_color"] = _lowess(8, "quantile_disc(abs(d), 0.5)", 3)


def _lowess_robust(points: int, reach: float, rounds: int) -> str:
    """Lines on the grid of each colour, fitted again with bisquare weights of the residuals."""
    parts = [
        "p as materialized (select row_number() over () as id, l_returnflag as color, l_quantity as x,"
        " l_extendedprice * case when l_orderkey % 40 = 0 then 10 else 1 end as y from lineitem)",
        "e as materialized (select color, min(x) as lo, (max(x) - min(x)) / {last} as step from p group by color)",
        "r0 as materialized (select id, color, x, y, 1.0::double as b from p)",
    ]
    for k in range(rounds + 1):
        parts += [
            f"w{k} as (select color, cast(i as integer) as point, lo + i * step as place, y, x - (lo + i * step) as d,"
            f" b * pow(1 - pow(abs(x - (lo + i * step)) / {{reach}}, 3), 3) as w from r{k} join e using (color),"
            f" range({{points}}) t(i) where abs(x - (lo + i * step)) < {{reach}})",
            f"f{k} as materialized (select color, point, place, (sum(w * d * d) * sum(w * y) - sum(w * d) * sum(w * d * y))"
            f" / (sum(w) * sum(w * d * d) - sum(w * d) * sum(w * d)) as fit from w{k} group by 1, 2, 3)",
        ]
        if k < rounds:
            parts += [
                f"o{k} as materialized (select id, r{k}.color, x, y, abs(y - (f.fit + ((x - lo) / step - f.point)"
                f" * (g.fit - f.fit))) as off from r{k} join e on r{k}.color = e.color"
                f" join f{k} f on f.color = e.color and f.point = least(floor((x - lo) / step), {{last}} - 1)"
                f" join f{k} g on g.color = e.color and g.point = f.point + 1)",
                f"m{k} as (select color, quantile_disc(off, 0.5) as median from o{k} group by color)",
                f"r{k + 1} as materialized (select id, color, x, y, case when off < 6 * median"
                f" then pow(1 - pow(off / (6 * median), 2), 2) else 0 end as b from o{k} join m{k} using (color))",
            ]
    ctes = ", ".join(parts).format(points=points, last=points - 1, reach=reach)
    return f"with {ctes} select color, point, round(place, 6) as x, round(fit, 3) as fit from f{rounds}"


ORACLE_SQL["lowess_robust"] = _lowess_robust(12, 15, 3)


def _box(color: str | None) -> str:
    key = f"{color} as color, " if color else ""
    names = "color, " if color else ""
    group = "group by color" if color else ""
    on = "using (color)" if color else "on true"
    return f"""
        with v as (select {key}value as v from events where value is not null),
        q as (select {names}quantile_disc(v, 0.25) as q1, quantile_disc(v, 0.5) as median,
                quantile_disc(v, 0.75) as q3 from v {group}),
        f as (select v.*, q1, median, q3,
                v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside
              from v join q {on})
        select {names}count(*) as n, round(min(v), 6) as min, round(any_value(q1), 6) as q1,
               round(any_value(median), 6) as median, round(any_value(q3), 6) as q3,
               round(max(v), 6) as max, round(min(v) filter (inside), 6) as lower_fence,
               round(max(v) filter (inside), 6) as upper_fence,
               count(*) filter (not inside) as n_outliers
        from f {group}"""


ORACLE_SQL["box_stats"] = _box(None)
ORACLE_SQL["box_stats_color"] = _box("event_type")
ORACLE_SQL["kde"] = """
    with e as (select min(value) as lo, max(value) as hi, stddev_samp(value) as sd, count(value) as n,
            (quantile_disc(value, 0.75) - quantile_disc(value, 0.25)) / 1.349 as iqr from events),
    b as (select *, 1.059 * least(sd, iqr) * pow(n, -0.2) as h from e),
    g as (select cast(i as integer) as point, lo + i * ((hi - lo) / 39) as x, n, h
          from b, range(40) t(i))
    select point, round(x, 6) as x,
           round(sum(exp(-0.5 * pow((value - x) / h, 2))) / (n * h * sqrt(2 * pi())), 9) as density
    from events, g where value is not null group by point, x, n, h"""
ORACLE_SQL["kde_binned"] = """
    with e as (select min(value) as lo, max(value) as hi, stddev_samp(value) as sd, count(value) as n,
            (quantile_disc(value, 0.75) - quantile_disc(value, 0.25)) / 1.349 as iqr from events),
    b as (select lo, (hi - lo) / 39 as step, 1.059 * least(sd, iqr) * pow(n, -0.2) as h, (hi - lo) / 4095 as width from e),
    v as (select event_type as color, (value - lo) / width as pos, least(floor((value - lo) / width), 4094) as place
          from events, b where value is not null),
    s as (select color, place, 1 - (pos - place) as mass from v union all select color, place + 1, pos - place from v),
    m as (select color, place, sum(mass) as mass from s group by 1, 2),
    t as (select color, sum(mass) as n from m group by 1)
    select color, cast(i as integer) as point, round(lo + i * step, 6) as x,
           round(sum(case when abs(place * width - i * step) < 6 * h
                     then mass * exp(-0.5 * pow((place * width - i * step) / h, 2)) else 0 end)
                 / (n * h * sqrt(2 * pi())), 9) as density
    from m join t using (color), b, range(40) g(i) group by color, i, lo, step, h, n"""


def _capped(columns: str, source: str, axes: list[str], color: str, key: str, most: int) -> str:
    """The first row of every cell and colour by digest, then the second ones, and so on."""
    share = f"{most}.0::double / count(distinct {color})"
    parts = f"floor(sqrt({share}))" if len(axes) == 2 else f"floor({share})"
    ends = ", ".join(f"min({a}) as lo{i}, max({a}) as hi{i}" for i, a in enumerate(axes))
    cells = ", ".join(f"least(parts - 1, floor(({a} - lo{i}) * parts / (hi{i} - lo{i})))" for i, a in enumerate(axes))
    return f"""
    with e as (select {parts} as parts, {ends} from {source}),
    r as (select t.*, md5({key}) as digest,
            row_number() over (partition by {color}, {cells} order by md5({key})) as turn from {source} t, e)
    select {columns} from r order by turn, digest limit {most}"""


ORACLE_SQL["scatter_capped"] = _capped(
    "l_quantity, l_extendedprice, l_returnflag, l_orderkey, l_linenumber", "lineitem",
    ["l_quantity", "l_extendedprice"], "l_returnflag", "l_orderkey || '|' || l_linenumber", 400,
)
ORACLE_SQL["rug_capped"] = _capped(
    "event_type as color, value", "(select * from events where value is not null)", ["value"], "event_type",
    "cast(event_id as varchar)", 300,
)
ORACLE_SQL["rug"] = "select event_type as color, value from events where value is not null"

# --- texts --------------------------------------------------------------------------
ORACLE_SQL["pretty_labels"] = (
    f"select 'label' as variable, {_pretty('label')} as value, count(*) as n from"
    " (select lower(o_orderstatus || '_' || o_orderpriority || '_LANE') as label from orders) group by 2"
)
ORACLE_SQL["slugify"] = r"""
    select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(text)),
        '[^\x00-\x7F]', '', 'g'), '[^\w\s-]', '', 'g'), '[-\s]+', '-', 'g'), '-_') as slug
    from documents"""
ORACLE_SQL["file_stems"] = r"""
    select page_id, file, case when file = '' then '' else regexp_replace(file, '^(.+)\.[^.]*$', '\1') end as stem
    from (select page_id, regexp_extract(regexp_replace(url, '[?#].*', ''), '([^/]*)$', 1) as file from pages)"""
ORACLE_SQL["split_clean"] = f"""
    with s as (select doc_id,
        list_transform(string_split(text, ','), lambda p: {O.strip('p')}) as kept,
        list_filter(list_transform(string_split_regex(text, ',|\\band\\b|;'),
            lambda p: {O.strip('p')}), lambda p: p <> '') as dropped from documents)
    select doc_id, cast(len(kept) as integer) as n_kept, md5(array_to_string(kept, '|')) as kept,
           cast(len(dropped) as integer) as n_dropped,
           md5(coalesce(array_to_string(dropped, '|'), '')) as dropped from s"""
ORACLE_SQL["keyword_category"] = "select doc_id, " + O.cases(
    [(O.holds("lower(text)", words), O.quote(name)) for name, words in KEYWORDS.items()], "'unknown'"
) + " as category from documents"
ORACLE_SQL["keyword_category_table"] = """
    with w as (select distinct unnest(string_split_regex(lower(text), '[^a-z]+')) as keyword from benchmark),
    r as (select 100 - length(keyword) as priority, substr(keyword, 1, 1) as category, keyword
          from w where keyword <> ''),
    h as (select conv_id, turn, min((priority, category)) as best
          from conversations join r on position(keyword in lower(text)) > 0 group by 1, 2)
    select conv_id, turn, coalesce(best[2], 'unknown') as category
    from conversations left join h using (conv_id, turn)"""


def _lookup(entries: list[tuple[str, str]]) -> str:
    rows = ", ".join(f"({i}, {O.quote(k)}, {O.quote(v)})" for i, (k, v) in enumerate(entries))
    return f"""
        with d(ord, key, val) as (values {rows})
        select p_partkey, arg_min(key, ord) as key from part
        left join d on position(val in p_name) > 0 or position(p_name in val) > 0 group by 1"""


ORACLE_SQL["lookup_substring"] = _lookup(list(DICTIONARY.items()))
ORACLE_SQL["lookup_nested"] = _lookup([(k, v) for k, values in NESTED_DICTIONARY.items() for v in values])
ORACLE_SQL["lookup_table"] = """
    with d as (select p_partkey as ord, 'part-' || cast(p_partkey as varchar) as key,
            p_type || ' ' || p_name || ' ' || cast(p_size as varchar) as val
        from part),
    t as (select p_partkey, p_name || ' ' || cast(p_size as varchar) as t from part
        union all
        select -p_partkey - 1, 'the ' || p_type || ' ' || p_name || ' '
            || cast(p_size as varchar) || ' ' || p_brand from part),
    u as (select distinct t from t),
    f as (select t, arg_min(key, ord) as key from u
        join d on position(t in val) > 0 or position(val in t) > 0 group by 1)
    select p_partkey, t, key from t left join f using (t)"""

# --- sources, sinks, inference --------------------------------------------------------
_prefix = "data:image/png;base64,"
_images = (
    "p as (select 'report-' || cast(page_id // 8 as varchar) as report, page_id % 8 as page_no,"
    f" '{_prefix}' || to_base64(encode(html)) as url from pages)"
)
ORACLE_SQL["page_payload"] = f"""
    with {_images}
    select report, cast(count(*) + 1 as integer) as n_parts, 'What happened?' as prompt,
           md5(string_agg(url, chr(10) order by page_no)) as images from p group by report"""
_json_head = '[{"role":"user","content":[{"type":"text","text":"%s"}'
_json_image = "',{\"type\":\"image_url\",\"image_url\":{\"url\":\"' || url || '\",\"detail\":\"high\"}}'"
ORACLE_SQL["request_text"] = f"""
    with {_images},
    r as (select report, '{_json_head % "What happened?"}'
            || string_agg({_json_image}, '' order by page_no) || ']}}]' as payload from p group by report)
    select report, cast(length(payload) as integer) as n_chars, md5(payload) as payload from r"""
_outcome = f"""
    with c as (select cast(conv_id as varchar) || '-' || cast(turn as varchar) as report,
            '{_prefix}' || to_base64(encode(text)) as url from conversations),
    m as (select report, length('{_json_head % "?"}' || {_json_image} || ']}}]') as n from c),
    a as (select report, n,
            case when n % 11 = 0 then 'rejected' when n % 13 = 0 then 'failed' else 'ok' end as status,
            case when n % 11 <> 0 and n % 7 = 0 then 2 else 1 end as attempts from m)
"""
ORACLE_SQL["batch_inference"] = _outcome + """
    select report, case when status = 'ok' then 'Q1. Yes, ' || cast(n as varchar) || ' characters.' end as response,
           status, case status when 'rejected' then 'refused' when 'failed' then 'ValueError: broken' end as error,
           cast(attempts as integer) as attempts from a"""
ORACLE_SQL["restarted_inference"] = f"select *, 1 as times from ({ORACLE_SQL['batch_inference']})"
ORACLE_SQL["inference_outcomes"] = _outcome + (
    "select 'status' as variable, status as value, count(*) as n from a group by 2"
)
ORACLE_SQL["resume_antijoin"] = (
    "select doc_id as report, source from documents"
    " where not exists (select 1 from labels l where l.doc_id = documents.doc_id)"
)
ORACLE_SQL["csv_roundtrip"] = _answers(
    _hist("(select * from rows join av using (report) join ov using (report))",
          ["q1_category", "q2_av_brand", "q2_other_vehicle"]),
    Q1, O.av_ctes(), O.vehicle_ctes(),
)
ORACLE_SQL["structured_csv"] = _answers(
    f"select {O.q4_columns()['q4_weather']} as weather,"
    f" cast(to_json({_q6['q6_contributing_factors']}) as varchar) as factors, count(*) as n"
    " from answers group by 1, 2"
)
ORACLE_SQL["append_answers"] = _answers(
    _hist("(select case when response is null then 'No' else q1_category end as q1_category"
          " from rows join responses using (report))", ["q1_category"]), Q1,
)
ORACLE_SQL["report_scan"] = (
    f"with {O.responses_cte('orders')}, parts as (select cast(split_part(report, '-', -1) as bigint) % 25 as part,"
    " coalesce(response, '') as r from responses)"
    " select part, cast(sum(strlen(r) + 1) as bigint) as n_bytes, cast(sum(length(r) + 1) as bigint) as n_chars,"
    " count(*) as n_responses, cast(sum(strlen(r) + 1) as bigint) as listed from parts group by part"
)
ORACLE_SQL["stream_intake"] = _answers(
    _hist("(select * from rows join av using (report) join ov using (report))",
          ["q1_category", "q2_av_brand", "q2_other_vehicle"]),
    Q1, O.av_ctes(), O.vehicle_ctes(),
)
ORACLE_SQL["stream_snapshot"] = (
    f"with {O.responses_cte('orders')} select files, true as complete, n_responses, n_chars"
    " from (select unnest(range(5, 26, 5)) as files),"
    " (select count(*) as n_responses, cast(sum(length(coalesce(response, ''))) as bigint) as n_chars from responses)"
)
_latest = (
    f"with {O.responses_cte('orders').replace('responses as', 'originals as')}, deliveries as ("
    "select report, response, 1 as answered_at from originals union all"
    " select report, 'Q1. No, corrected.', cast(split_part(report, '-', -1) as bigint) % 2 * 2 from originals"
    " where cast(split_part(report, '-', -1) as bigint) % 3 = 0),"
    " responses as (select report, response from deliveries qualify row_number() over"
    " (partition by report order by answered_at desc, response desc nulls last) = 1),"
    f" {O.answers_cte()}, {Q1[0]}, counted as ({_hist('rows', ['q1_category'])}) "
)
ORACLE_SQL["stream_latest"] = (
    _latest + "select *, 'forward' as delivery from counted union all select *, 'backward' from counted"
)
ORACLE_SQL["stream_structured"] = _answers(
    _hist("(select * from rows join av using (report))", ["q1_category", "q2_av_brand", "q2_av_year"]),
    Q1, O.av_ctes(),
)
ORACLE_SQL["stream_counts"] = _answers(
    "select q2_other_road_user as value, count(*) as n from ru where q2_other_road_user is not null group by 1",
    O.road_user_ctes(),
)
