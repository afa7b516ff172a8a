"""The tables behind the charts: histograms, bars, scatter plots, marginals.

Everything is a grouped or projected DataFrame that a plotting tool can draw as
is.  Counting uses partial aggregation before the exchange, so a value that holds
a large share of all rows costs one partial row per task.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import pretty_label
from . import statistics as S


def _names(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def prettify(df: DataFrame, columns) -> DataFrame:
    """Pretty labels in the string columns among ``columns``; others stay as they are."""
    texts = [c for c in columns if c and isinstance(df.schema[c].dataType, StringType)]
    return df.withColumns({c: pretty_label(F.col(c)) for c in texts}) if texts else df


def _long(df: DataFrame, x: list[str], keep=()) -> DataFrame:
    """Rows ``(*keep, variable, value)`` with the values as text; ``keep`` goes with one column."""
    if len(x) == 1:
        return df.select(*keep, F.lit(x[0]).alias("variable"), F.col(x[0]).cast("string").alias("value"))
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in x])
    return texts.unpivot([], x, "variable", "value")


def _counts(long: DataFrame, *by: str) -> DataFrame:
    """Rows per value without the nulls.

    Nulls are counted as zero and dropped afterwards.  A filter on the value itself
    would be pushed below the rules that derive it and evaluate them twice.
    """
    return long.groupBy("variable", "value", *by).agg(F.count("value").alias("n")).where("n > 0")


def hist(
    df: DataFrame,
    x,
    nbins: int | None = None,
    color: str | None = None,
    pretty: bool = False,
    sort_desc: bool = True,
    top: int | None = None,
) -> DataFrame:
    """Histogram of one or more columns.

    Without ``nbins``: ``(variable, value[, color], n)``, one row per value that
    occurs; nulls are left out, ``''`` is a value.  With ``nbins``: ``(variable,
    bin, bin_start, bin_end[, color], n)`` with equal-width bins over the range.
    Values are ordered by their total, largest first, then by name.  ``color``
    splits the counts and goes with a single ``x`` only.  ``top`` keeps the most
    frequent values.
    """
    x = _names(x)
    if color and len(x) > 1:
        raise ValueError("color can be used with a single column only")
    if color and top:
        raise ValueError("top cannot be combined with color")
    if pretty:
        df = prettify(df, [*x, color])
    if nbins:
        parts = [S.binned_counts(df, c, nbins, color) for c in x]
        binned = reduce(DataFrame.unionByName, parts)
        return binned.orderBy("variable", "bin") if sort_desc else binned

    extra = [F.col(color).alias("color")] if color else []
    counts = _counts(_long(df, x, extra), *(["color"] if color else []))
    if color:
        # One row per value and colour is left here, so the totals are a small join.
        totals = counts.groupBy("value").agg(F.sum("n").alias("_total"))
        counts = counts.join(totals, "value").select("variable", "value", "color", "n", "_total")
        order = [F.desc("_total"), F.asc("value"), F.asc("color")]
        return (counts.orderBy(*order) if sort_desc else counts).drop("_total")
    if sort_desc or top:
        counts = counts.orderBy(F.desc("n"), F.asc("variable"), F.asc("value"))
    return counts.limit(top) if top else counts


def hist_nested(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Histogram over the fields of a struct column; lists count each of their items."""
    pairs = []
    for field in df.schema[column].dataType.fields:
        values = F.col(f"_s.{field.name}")
        items = values if field.dataType.typeName() == "array" else F.array(values)
        pairs.append(F.transform(items.cast("array<string>"), _pair(field.name)))
    # All fields are counted in one pass over the table.
    long = df.select(F.col(column).alias("_s")).select(F.inline(F.concat(*pairs)))
    counts = _counts(long).orderBy(F.desc("n"), F.asc("variable"), F.asc("value"))
    return counts.limit(top) if top else counts


def _pair(name: str):
    return lambda value: F.struct(F.lit(name).alias("variable"), value.alias("value"))


def bar(df: DataFrame, y, x: str, stacked: bool = False, pretty: bool = False) -> DataFrame:
    """Bars ``(x, series_no, series, value[, start, end])``, one per row and ``y`` column.

    ``x`` names the key of a bar; a DataFrame has no row index to fall back on.
    Stacked segments lie on top of each other in the order of ``y``: their offsets
    are sums over columns of the same row and need no window.
    """
    y = _names(y)
    if pretty:
        df = prettify(df, y)
    mixed = len({df.schema[c].dataType for c in y}) > 1
    segments = []
    for i, name in enumerate(y):
        value = F.col(name).cast("double") if mixed else F.col(name)
        fields = [F.lit(i).alias("series_no"), F.lit(name).alias("series"), value.alias("value")]
        if stacked:
            lower = reduce(add, [F.coalesce(F.col(c), F.lit(0)) for c in y[:i]], F.lit(0))
            start = lower.cast("double")
            fields += [
                start.alias("start"),
                (start + F.coalesce(F.col(name), F.lit(0)).cast("double")).alias("end"),
            ]
        segments.append(F.struct(*fields))
    return df.select(F.col(x).alias("x"), F.inline(F.array(*segments)))


def capped(
    df: DataFrame, axes, most: int, color: str | None = None, key=None, keep=()
) -> DataFrame:
    """Up to ``most`` rows to draw, repeatable, with every region and colour that has any.

    The range of each of the one or two number ``axes`` is cut evenly, into as many parts as let
    all cells of all colours together be ``most`` or fewer.  Rows are ordered within their cell
    and colour by a digest of ``key``, columns that tell rows apart (else of all columns returned).
    The first row of every cell and colour is taken, then the second of each, and so on; the last
    round goes by digest.  So outliers and thin regions stay.  With more colours than ``most``, some
    colours are left out.  Rows without a number on an axis cannot be drawn and are left out.
    Returns the axes, ``color`` and ``keep`` under their own names.

    A task keeps ``most`` rows of a cell and colour at most before rows are exchanged.
    """
    axes, key = _names(axes), _names(key) if key else None
    if not 1 <= len(axes) <= 2 or not all(S.is_number(df, c) for c in axes):
        raise ValueError("one or two number columns are needed")
    if most < 1:
        raise ValueError("most has to be 1 at least")
    names = list(dict.fromkeys([*axes, *([color] if color else []), *keep]))
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key or names)]
    rows = df.select(
        F.struct(*names).alias("row"), F.md5(F.concat_ws("|", *fields)).alias("digest"),
        (F.col(color) if color else F.lit(None)).alias("color"),
        *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(axes)],
    )
    for i in range(len(axes)):
        rows = rows.where(F.col(f"v{i}").isNotNull() & ~F.isnan(f"v{i}") & (F.abs(f"v{i}") != float("inf")))
    colours = F.count_distinct("color") + F.max(F.col("color").isNull().cast("int"))
    ends = [f(f"v{i}").alias(f"{f.__name__}{i}") for i in range(len(axes)) for f in (F.min, F.max)]
    whole = rows.agg(F.struct(colours.alias("colours"), *ends).alias("s")).scalar()
    rows = rows.withColumn("s", whole)
    share = F.lit(float(most)) / F.col("s.colours")
    parts = F.greatest(F.lit(1), F.floor(F.sqrt(share) if len(axes) == 2 else share))
    cells = [
        F.coalesce(F.least(parts - 1, F.floor(F.try_divide(
            (F.col(f"v{i}") - F.col(f"s.min{i}")) * parts, F.col(f"s.max{i}") - F.col(f"s.min{i}")
        ))), F.lit(0)).alias(f"c{i}")
        for i in range(len(axes))
    ]
    placed = rows.select("row", "digest", "color", *cells)
    first = W.partitionBy("color", *[f"c{i}" for i in range(len(axes))]).orderBy("digest")
    turns = placed.withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= most)
    return turns.orderBy("turn", "digest").limit(most).select("row.*")


def scatter(
    df: DataFrame,
    x: str,
    y: str,
    color: str | None = None,
    symbol: str | None = None,
    size: str | None = None,
    text: str | None = None,
    hover=None,
    trendline: str | None = None,
    marker_size: int | None = None,
    pretty: bool = False,
    marginal_x: str | None = "violin",
    marginal_y: str | None = "violin",
    fraction: float | None = None,
    most: int | None = None,
    key=None,
) -> dict[str, DataFrame]:
    """Tables of a scatter plot: ``points``, ``trendline``, ``marginal_x``, ``marginal_y``.

    ``fraction`` draws a sample of the points, ``most`` draws so many with all regions of the plot
    (see ``capped``, also for ``key``); statistics always use all rows.
    """
    if fraction and most:
        raise ValueError("fraction and most cannot be used together")
    if marker_size and size:
        raise ValueError("marker_size and size cannot be used together")
    if marker_size and "histogram" in (marginal_x, marginal_y):
        raise ValueError("marker_size cannot be used together with a histogram marginal")
    if trendline not in (None, "ols", "lowess"):
        raise ValueError(f"unknown trendline {trendline!r}")
    shown = list(dict.fromkeys(c for c in [x, y, color, symbol, size, text, *(hover or [])] if c))
    if pretty:
        df = prettify(df, dict.fromkeys(c for c in (x, y, color, size, text) if c))
    points = df.select(*shown)
    if most:
        points = capped(df, [x, y], most, color, key, shown)
    tables = {"points": points.sample(fraction) if fraction else points}
    if trendline == "ols":
        tables["trendline"] = S.ols(df, x, y, color)
    elif trendline == "lowess":
        tables["trendline"] = S.lowess(df, x, y, color)
    for name, column, kind in (("marginal_x", x, marginal_x), ("marginal_y", y, marginal_y)):
        if kind:
            tables[name] = marginal(df, column, kind, color)
    return tables


def marginal(
    df: DataFrame,
    x: str,
    kind: str,
    color: str | None = None,
    nbins: int = 20,
    fraction: float | None = None,
    most: int | None = None,
    key=None,
) -> DataFrame:
    """Marginal of a column: ``rug``, ``histogram``, ``box`` or ``violin``.

    ``fraction`` or ``most`` (see ``capped``) bound the ticks of a rug.
    """
    if kind == "rug" and most:
        ticks = capped(df, x, most, color, key)
        return ticks.select(*[F.col(color).alias("color")] if color else [], F.col(x).alias("value"))
    if kind == "rug":
        by = [F.col(color).alias("color")] if color else []
        ticks = df.where(F.col(x).isNotNull()).select(*by, F.col(x).alias("value"))
        return ticks.sample(fraction) if fraction else ticks
    if not S.is_number(df, x):
        # Categories have no quartiles or density: their counts are the marginal.
        return hist(df, x, color=color)
    if kind == "histogram":
        return S.binned_counts(df, x, nbins, color)
    if kind == "box":
        return S.box(df, x, color)
    if kind == "violin":
        return S.density(df, x, color)
    raise ValueError(f"unknown marginal {kind!r}")
