"""Chart statistics as single-pass aggregates.

Range, spread and bandwidth come from scalar subqueries over the same table; the
statistic itself is one aggregate with partial sums in every task.  A curve over
m grid points is m sums side by side: no row is ever multiplied, nothing is
joined, and only m numbers per task are exchanged.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..session import scratch_folder

# Bandwidths at which the kernel of a binned density is cut.
CUT = 6
# Value ranges that ranks are first looked for in; their counts are ordered in one task per group.
RANGES = 1 << 16


def is_number(df: DataFrame, x: str) -> bool:
    return isinstance(df.schema[x].dataType, NumericType)


def _numbers(df: DataFrame, color: str | None = None, **columns: str) -> tuple[DataFrame, list[str]]:
    """Finite values as doubles under new names, with the colour column if any."""
    by = [F.col(color).alias("color")] if color else []
    rows = df.select(*by, *[F.col(c).cast("double").alias(name) for name, c in columns.items()])
    for name in columns:
        rows = rows.where(F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) != float("inf")))
    return rows, ["color"] if color else []


def _scalar(df: DataFrame, **aggregates: Column) -> Column:
    """Aggregates over the whole table as one struct-valued scalar subquery."""
    return df.agg(F.struct(*[a.alias(name) for name, a in aggregates.items()]).alias("s")).scalar()


def binned_counts(df: DataFrame, x: str, nbins: int, color: str | None = None) -> DataFrame:
    """Counts in ``nbins`` equal-width bins; the last bin includes the maximum."""
    rows, by = _numbers(df, color, v=x)
    ends = _scalar(rows, lo=F.min("v"), hi=F.max("v"))
    rows = rows.withColumns({"lo": ends["lo"], "hi": ends["hi"]})
    position = F.floor((F.col("v") - F.col("lo")) * nbins / (F.col("hi") - F.col("lo")))
    number = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(position, F.lit(nbins - 1)))
    counts = (
        rows.withColumn("bin", number.cast("int"))
        .groupBy("bin", *by)
        .agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    )
    width = (F.col("hi") - F.col("lo")) / nbins
    return counts.select(
        F.lit(x).alias("variable"),
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        *by,
        "n",
    )


def _counted(rows: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, v, n)``: how often each value occurs."""
    return rows.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"))


def quantiles(counted: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """``(*by, q)``: the values of rank ``ceil(share * rows)`` of every group, exact at any size.

    ``counted`` has ``(*by, v, n)``, a value in one row or in several.  Values are counted by ranges first; only
    those of the ranges that hold a rank are then counted one by one and put in order.  Ranges are even on a scale of signed
    logarithms, which keeps the order and is not spoilt by a few huge values.
    """
    placed = counted.withColumn("g", F.signum("v") * F.log1p(F.abs("v")))
    ends = _scalar(placed, lo=F.min("g"), hi=F.max("g"))
    share = F.try_divide(F.col("g") - ends["lo"], ends["hi"] - ends["lo"])
    placed = placed.withColumn("part", F.coalesce(F.floor(share * RANGES), F.lit(0)).cast("int")).drop("g")

    upto = F.sum("m").over(W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, 0))
    parts = placed.groupBy(*by, "part").agg(F.sum("n").alias("m")).withColumns(
        {"upto": upto, "rows": F.sum("m").over(W.partitionBy(*by))}
    )
    ranks = F.array(*[F.greatest(F.lit(1), F.ceil(F.col("rows") * F.lit(float(s)))).cast("long") for s in shares])
    wanted = parts.select(
        *[F.col(c).alias(f"_{c}") for c in by], F.col("part").alias("_part"),
        (F.col("upto") - F.col("m")).alias("before"), "upto", F.posexplode(ranks).alias("k", "rank"),
    ).where((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("upto"))).drop("upto")

    same = F.col("part") == F.col("_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    within = W.partitionBy(*by, "k").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    # One row per group and rank, so the values stay where they are.
    held = placed.join(F.broadcast(wanted), same).groupBy(*by, "k", "before", "rank", "v").agg(F.sum("n").alias("n"))
    ordered = held.withColumn("upto", F.col("before") + F.sum("n").over(within))
    found = ordered.where((F.col("upto") - F.col("n") < F.col("rank")) & (F.col("rank") <= F.col("upto")))
    values = F.array_sort(F.collect_list(F.struct("k", "v")))
    return found.groupBy(*by).agg(F.transform(values, lambda e: e["v"]).alias("q"))


def _with_quantiles(rows: DataFrame, by: list[str], table: DataFrame) -> DataFrame:
    """Rows with the ``q`` of their group, of which there is one row each."""
    if not by:
        return rows.withColumn("q", table.select("q").scalar())
    renamed = table.select(*[F.col(c).alias(f"_{c}") for c in by], "q")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    # A row per colour goes to the rows, which stay where they are read.
    return rows.join(F.broadcast(renamed), same).drop(*[f"_{c}" for c in by])


def box(df: DataFrame, x: str, color: str | None = None) -> DataFrame:
    """Quartiles, fences (outermost values within 1.5 box lengths) and outlier count.

    Quartiles are values of the column, those of rank ``ceil(share * rows)``.
    """
    rows, by = _numbers(df, color, v=x)
    counted = _counted(rows, by)
    counted = _with_quantiles(counted, by, quantiles(counted, by, [0.25, 0.5, 0.75]))
    q1, q2, q3 = (F.col("q")[i] for i in range(3))
    reach = (q3 - q1) * 1.5
    low, high = q1 - reach, q3 + reach
    inside = F.col("v").between(low, high)
    return counted.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.min("v").alias("min"),
        F.first(q1).alias("q1"),
        F.first(q2).alias("median"),
        F.first(q3).alias("q3"),
        F.max("v").alias("max"),
        F.min(F.when(inside, F.col("v"))).alias("lower_fence"),
        F.max(F.when(inside, F.col("v"))).alias("upper_fence"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("n_outliers"),
    )


def _curve(table: DataFrame, by: list[str], points: int, name: str, value: str) -> DataFrame:
    """Turn one wide row per group into rows ``(point, x, <name>)``.

    ``value`` is SQL for the curve at point ``{i}``; ``lo`` and ``step`` are columns.
    """
    cells = ", ".join(
        f"struct({i} as point, lo + step * {i} as x, {value.format(i=i)} as {name})" for i in range(points)
    )
    return table.select(*by, F.expr(f"inline(array({cells}))"))


def density(
    df: DataFrame,
    x: str,
    color: str | None = None,
    points: int = 50,
    bandwidth: float | None = None,
    bins: int | None = None,
) -> DataFrame:
    """Gaussian kernel density ``([color,] point, x, density)`` on an even grid.

    The bandwidth is ``1.059 * min(sd, iqr / 1.349) * n ** -0.2`` unless given.
    Colours share grid and bandwidth; each density integrates to one by itself.

    With ``bins``, each value is first shared out to the two nearest of so many even places over
    the range, and the kernel is cut at CUT bandwidths.  A row then costs the same whatever the
    number of points.  The curve differs from the exact one by at most
    ``((width / h) ** 2 / 8 + exp(-CUT ** 2 / 2)) / (h * sqrt(2 * pi))``, for places ``width`` apart
    and bandwidth ``h``.
    """
    if bins is not None and bins < 2:
        raise ValueError("bins has to be 2 at least")
    rows, by = _numbers(df, color, v=x)
    s = _scalar(rows, lo=F.min("v"), hi=F.max("v"), sd=F.stddev("v"), n=F.count("v"))
    if not bandwidth:
        rows = _with_quantiles(rows, [], quantiles(_counted(rows, []), [], [0.25, 0.75]))
        iqr = (F.col("q")[1] - F.col("q")[0]) / 1.349
    else:
        iqr = F.lit(None).cast("double")
    spread = F.when(iqr > 0, F.least(F.col("s.sd"), iqr)).otherwise(F.col("s.sd"))
    rule = F.lit(1.059) * spread * F.pow(F.col("s.n").cast("double"), F.lit(-0.2))
    rows = rows.withColumn("s", s)
    rows = rows.withColumns({
        "lo": F.col("s.lo"),
        "step": (F.col("s.hi") - F.col("s.lo")) / (points - 1),
        "h": F.lit(float(bandwidth)) if bandwidth else rule,
    }).drop("s")
    # In units of the bandwidth, so that a grid point is a multiple of one column.
    rows = rows.withColumns({"z": (F.col("v") - F.col("lo")) / F.col("h"), "dz": F.col("step") / F.col("h")})
    kernel = "exp(-0.5D * (z - {i} * dz) * (z - {i} * dz))"
    if bins:
        rows = _shared_out(rows, by, points, bins)
        kernel = f"case when abs(z - {{i}} * dz) < {CUT} then mass * {kernel} else 0D end"
    kernels = [F.expr(f"sum({kernel.format(i=i)}) as k{i}") for i in range(points)]
    n = F.sum("mass") if bins else F.count(F.lit(1))
    sums = rows.groupBy(*by).agg(n.alias("n"), *[F.first(c).alias(c) for c in ("lo", "step", "h")], *kernels)
    return _curve(sums, by, points, "density", f"k{{i}} / (n * h * {math.sqrt(2 * math.pi)!r}D)")


def _shared_out(rows: DataFrame, by: list[str], points: int, bins: int) -> DataFrame:
    """``(*by, mass, z, dz, lo, step, h)``: the rows of each group as masses at ``bins`` even places.

    Places between two neighbours give both a share that falls with the distance; the shares are
    added up per place before anything is exchanged.
    """
    last = bins - 1
    # In places from the lowest value on; all is at place 0 if there is one value only.
    at = F.expr(f"coalesce(try_divide((v - lo) * {last}, step * {points - 1}), 0D)")
    placed = rows.withColumn("at", at).withColumn("place", F.least(F.floor("at"), F.lit(last - 1)).cast("int"))
    share = F.col("at") - F.col("place")
    summed = placed.groupBy(*by, "place").agg(
        F.sum(1 - share).alias("low"), F.sum(share).alias("high"),
        *[F.first(c).alias(c) for c in ("lo", "step", "h", "dz")],
    )
    each = summed.select(*by, "lo", "step", "h", "dz", F.expr(
        "inline(array(struct(place as place, low as mass), struct(place + 1 as place, high as mass)))"
    ))
    return each.withColumn("z", F.expr(f"place * dz * {points - 1} / {last}"))


def ols(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Least-squares line ``([color,] n, slope, intercept, r2)``."""
    rows, by = _numbers(df, color, x=x, y=y)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"),
    )


def lowess(
    df: DataFrame,
    x: str,
    y: str,
    color: str | None = None,
    points: int = 20,
    frac: float = 2 / 3,
    bandwidth: float | None = None,
    rounds: int = 0,
) -> DataFrame:
    """Locally weighted line ``([color,] point, x, fit)`` on an even grid.

    At each grid point a line is fitted with tricube weights.  The window holds the nearest
    ``frac`` of the rows, or reaches ``bandwidth`` to both sides where that is given.  Each colour
    has its own grid and windows.

    ``rounds`` fits again so many times, with rows that lie far off weighing less: a row's residual
    from the line (straight between grid points) is set against 6 times the median of the absolute
    residuals of its colour, and bisquare weights multiply the tricube ones.  If that median is 0,
    all rows of the colour keep their full weight.  Lines and medians of a round, a row per colour each, are
    written below ``spark.checkpoint.dir``, so the rounds run when this is called.
    """
    rows, by = _numbers(df, color, x=x, y=y)
    ends = rows.groupBy(*by).agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("q"))
    grid = range(points)

    def on_grid(table: DataFrame) -> DataFrame:
        """Ends and step of the group's own grid."""
        own = _with_quantiles(table, by, ends)
        return own.withColumns({"lo": F.col("q.lo"), "step": (F.col("q.hi") - F.col("q.lo")) / (points - 1)}).drop("q")

    if bandwidth:
        rows = on_grid(rows).withColumn("reach", F.array_repeat(F.lit(float(bandwidth)), points))
    else:
        # Values are counted before they are measured from each point of the grid.
        counted = on_grid(rows.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("n")))
        away = counted.select(*by, "n", "x", "lo", "step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
        away = away.select(*by, "point", "n", F.expr("abs(x - (lo + point * step))").alias("v"))
        reach = quantiles(away, [*by, "point"], [frac]).groupBy(*by).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("point", F.col("q")[0].alias("r")))), lambda e: e["r"]).alias("q")
        )
        rows = _with_quantiles(on_grid(rows), by, reach).withColumnRenamed("q", "reach")
    table = _line_sums(rows, by, points)
    for _ in range(rounds):
        cells = ", ".join(_FIT.format(i=i) for i in grid)
        lines = _written(table.select(*by, F.expr(f"array({cells})").alias("q")))
        # Straight between the two grid points around x; all is at point 0 if there is one x only.
        off = _with_quantiles(rows, by, lines).withColumnRenamed("q", "line").withColumn(
            "at", F.expr("coalesce(try_divide(x - lo, step), 0D)")
        ).withColumn("left", F.greatest(F.lit(0), F.least(F.floor("at"), F.lit(points - 2))).cast("int"))
        fit = F.expr("get(line, left) + (at - left) * coalesce(get(line, left + 1) - get(line, left), 0D)")
        off = off.withColumn("off", F.abs(F.col("y") - fit)).drop("line", "at", "left")
        # Residuals hardly repeat: counting them all would hold a row for each.
        known = off.where("off is not null").select(*by, F.col("off").alias("v"), F.lit(1).cast("long").alias("n"))
        # Colours without any residual are kept with a null median.
        medians = quantiles(known, by, [0.5]).unionByName(
            lines.select(*by, F.lit(None).cast("array<double>").alias("q"))
        )
        medians = _written(medians.groupBy(*by).agg(F.max("q").alias("q")))
        far = _with_quantiles(off, by, medians).withColumn("u", F.expr("try_divide(off, 6 * get(q, 0))")).drop("q")
        weight = "case when off is null or u is null then 1D when u < 1 then pow(1 - u * u, 2) else 0D end"
        table = _line_sums(far.withColumn("robust", F.expr(weight)), by, points, "robust")
    return _curve(table, by, points, "fit", _FIT)


# A line's value at the grid point, from the sums there; where all x are one, the mean.
_DET = "(s{i} * sdd{i} - sd{i} * sd{i})"
_FIT = (
    f"case when {_DET} > s{{i}} * s{{i}} * 1e-12D"
    f" then try_divide(sdd{{i}} * sy{{i}} - sd{{i}} * sdy{{i}}, {_DET})"
    " else try_divide(sy{i}, s{i}) end"
)


def _written(df: DataFrame) -> DataFrame:
    """The rows as a written table in the shared folder."""
    path = scratch_folder(df.sparkSession, "line")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _line_sums(rows: DataFrame, by: list[str], points: int, weight: str | None = None) -> DataFrame:
    """Weighted sums at every grid point, one row per group; ``weight`` multiplies the tricube weights."""
    grid = range(points)
    rows = rows.withColumns({f"d{i}": F.expr(f"x - (lo + {i} * step)") for i in grid})
    rows = rows.withColumns({f"u{i}": F.expr(f"abs(d{i}) / reach[{i}]") for i in grid})
    rows = rows.withColumns({
        f"w{i}": F.expr(f"case when u{i} < 1 then pow(1 - u{i} * u{i} * u{i}, 3) else 0D end") for i in grid
    })
    if weight:
        rows = rows.withColumns({f"w{i}": F.col(f"w{i}") * F.col(weight) for i in grid})
    sums = [
        F.expr(f"sum({term.format(w=f'w{i}', d=f'd{i}')}) as {name}{i}")
        for i in grid
        for name, term in (
            ("s", "{w}"), ("sd", "{w} * {d}"), ("sdd", "{w} * {d} * {d}"),
            ("sy", "{w} * y"), ("sdy", "{w} * {d} * y"),
        )
    ]
    return rows.groupBy(*by).agg(F.first("lo").alias("lo"), F.first("step").alias("step"), *sums)
