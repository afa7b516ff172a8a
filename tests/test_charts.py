"""Chart tables and statistics, partly against brute force with numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportweave.operators import charts as C
from reportweave.operators import statistics as S


@pytest.fixture(scope="module")
def letters(spark):
    rows = [("a", "x", 1.0), ("a", "y", 2.0), (None, "x", 3.0), ("b_C", None, None), ("", "x", 11.0)]
    return spark.createDataFrame(rows, "v string, w string, n double")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_hist(letters):
    assert rows(C.hist(letters, "v")) == [("v", "a", 2), ("v", "", 1), ("v", "b_C", 1)]
    assert rows(C.hist(letters, ["v"], top=1)) == [("v", "a", 2)]
    assert ("v", "B c", 1) in rows(C.hist(letters, "v", pretty=True))
    assert "b_C" in [r.v for r in letters.collect()]
    total = C.hist(letters, ["v", "w"]).agg(F.sum("n")).first()[0]
    assert total == 8


def test_hist_color(letters):
    got = rows(C.hist(letters, "v", color="w"))
    assert got[:2] == [("v", "a", "x", 1), ("v", "a", "y", 1)]
    assert ("v", "b_C", None, 1) in got and len(got) == 4
    renamed = letters.select(F.col("v").alias("color"), "w")
    assert rows(C.hist(renamed, "color", color="w"))[:2] == [("color", "a", "x", 1), ("color", "a", "y", 1)]
    with pytest.raises(ValueError):
        C.hist(letters, ["v", "w"], color="n")


def test_hist_bins(letters):
    got = rows(C.hist(letters, "n", nbins=5))
    assert got == [("n", 0, 1.0, 3.0, 2), ("n", 1, 3.0, 5.0, 1), ("n", 4, 9.0, 11.0, 1)]
    same = letters.select(F.lit(7.0).alias("k"))
    assert [(r.bin, r.n) for r in C.hist(same, "k", nbins=3).collect()] == [(0, 5)]


def test_hist_does_not_repeat_the_rules(spark, sf_dir):
    from catalog.queries import QUERIES

    plan = QUERIES["hist_topk"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 4  # the answer, brand, model and free text: once each


def test_hist_nested(spark):
    df = spark.createDataFrame([((True, ["a", "b", "a"]),), ((None, []),)], "s struct<f: boolean, l: array<string>>")
    assert rows(C.hist_nested(df, "s")) == [("l", "a", 2), ("f", "true", 1), ("l", "b", 1)]


def test_bar(spark):
    df = spark.createDataFrame([("p", 1, 2.5), ("q", None, 4.0)], "k string, a int, b double")
    assert rows(C.bar(df, ["a", "b"], "k", stacked=True)) == [
        ("p", 0, "a", 1.0, 0.0, 1.0), ("p", 1, "b", 2.5, 1.0, 3.5),
        ("q", 0, "a", None, 0.0, 0.0), ("q", 1, "b", 4.0, 0.0, 4.0),
    ]
    assert C.bar(df, "a", "k").columns == ["x", "series_no", "series", "value"]
    plan = C.bar(df, ["a", "b"], "k", stacked=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_scatter_arguments(letters):
    with pytest.raises(ValueError):
        C.scatter(letters, "n", "v", size="w", marker_size=3)
    with pytest.raises(ValueError):
        C.scatter(letters, "n", "v", marker_size=3, marginal_x="histogram")
    with pytest.raises(ValueError):
        C.scatter(letters, "n", "v", trendline="spline")
    tables = C.scatter(letters, "n", "n", color="v", hover=["w"], marginal_x="rug", marginal_y=None, trendline="ols")
    assert set(tables) == {"points", "trendline", "marginal_x"}
    assert tables["points"].columns == ["n", "v", "w"]
    # Text axes have counts as their marginal.
    assert C.scatter(letters, "v", "n", marginal_y=None)["marginal_x"].columns == ["variable", "value", "n"]


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    x = rng.gamma(2.0, 3.0, 400)
    y = np.sin(x / 3) * 5 + rng.normal(0, 1, 400)
    color = np.where(np.arange(400) % 3 == 0, "a", "b")
    df = spark.createDataFrame(
        [(float(p), float(q), str(c)) for p, q, c in zip(x, y, color)], "x double, y double, c string"
    )
    return df, x, y, color


def test_density(cloud):
    df, x, _, color = cloud
    got = S.density(df, "x", points=30).orderBy("point").collect()
    n, sd = len(x), x.std(ddof=1)
    s = np.sort(x)
    iqr = s[int(np.ceil(0.75 * n)) - 1] - s[int(np.ceil(0.25 * n)) - 1]
    h = 1.059 * min(sd, iqr / 1.349) * n ** -0.2
    grid = np.linspace(x.min(), x.max(), 30)
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (n * h * np.sqrt(2 * np.pi))
    assert np.allclose([r.density for r in got], want) and np.allclose([r.x for r in got], grid)
    by_color = S.density(df, "x", "c", points=9, bandwidth=1.5).where("color = 'a'")
    part = x[color == "a"]
    grid = np.linspace(x.min(), x.max(), 9)
    want = np.exp(-0.5 * ((grid[:, None] - part) / 1.5) ** 2).sum(axis=1) / (len(part) * 1.5 * np.sqrt(2 * np.pi))
    assert np.allclose([r.density for r in by_color.orderBy("point").collect()], want)


def local_line(x, y, at, reach):
    w = np.clip(1 - (np.abs(x - at) / reach) ** 3, 0, None) ** 3
    slope, level = np.polyfit(x - at, y, 1, w=np.sqrt(w))
    return level


def test_lowess_nearest_and_fixed(cloud):
    df, x, y, _ = cloud
    grid = np.linspace(x.min(), x.max(), 8)
    got = S.lowess(df, "x", "y", points=8, frac=0.4).orderBy("point").collect()
    k = int(np.ceil(0.4 * len(x))) - 1
    want = [local_line(x, y, g, np.sort(np.abs(x - g))[k]) for g in grid]
    assert np.allclose([r.fit for r in got], want)
    got = S.lowess(df, "x", "y", points=8, bandwidth=6).orderBy("point").collect()
    assert np.allclose([r.fit for r in got][:5], [local_line(x, y, g, 6.0) for g in grid[:5]])


def test_ols(cloud):
    df, x, y, color = cloud
    for row in S.ols(df, "x", "y", "c").collect():
        mine = color == row.color
        slope, level = np.polyfit(x[mine], y[mine], 1)
        assert np.isclose(row.slope, slope) and np.isclose(row.intercept, level)
        assert np.isclose(row.r2, np.corrcoef(x[mine], y[mine])[0, 1] ** 2)


def test_box(cloud):
    df, x, _, color = cloud

    def want(v):
        s = np.sort(v)
        q1, q2, q3 = (s[int(np.ceil(p * len(s))) - 1] for p in (0.25, 0.5, 0.75))
        inside = s[(s >= q1 - 1.5 * (q3 - q1)) & (s <= q3 + 1.5 * (q3 - q1))]
        return (len(s), s[0], q1, q2, q3, s[-1], inside[0], inside[-1], len(s) - len(inside))

    assert np.allclose(tuple(S.box(df, "x").first()), want(x))
    for row in S.box(df, "x", "c").collect():
        assert np.allclose(tuple(row)[1:], want(x[color == row.color]))


def test_quartiles_are_exact_at_any_size(spark):
    n = 1_200_000
    rows = spark.range(n).selectExpr("cast(id * 7 % 1200001 as double) as v", "if(id % 3 = 0, null, 'c') as c")
    values = np.arange(n) * 7 % 1_200_001.0
    rank = [int(np.ceil(p * n)) - 1 for p in (0.25, 0.5, 0.75)]
    one = S.box(rows, "v").first()
    assert (one.q1, one.median, one.q3) == tuple(np.sort(values)[rank])
    for row in S.box(rows, "v", "c").collect():
        part = np.sort(values[(np.arange(n) % 3 == 0) == (row.color is None)])
        assert row.median == part[int(np.ceil(len(part) / 2)) - 1]
    # One huge value does not put all others in one range, and does not change their order.
    odd = spark.range(5001).selectExpr("if(id = 0, 1e300, id / 1000) as v")
    assert S.box(odd, "v").first().median == 2.501
    assert S.box(rows.limit(0), "v").first().n == 0 and S.box(rows.limit(0), "v", "c").count() == 0


def test_lowess_windows_are_those_of_a_colour(spark):
    rows = [("far", 1000.0 + i, 3.0 * i) for i in range(200)] + [("near", float(i), 2.0 * i) for i in range(20)]
    df = spark.createDataFrame(rows, "c string, x double, y double")
    got = S.lowess(df, "x", "y", "c", points=6, frac=0.5).orderBy("color", "point").collect()
    assert np.allclose([r.x for r in got], [*np.linspace(1000, 1199, 6), *np.linspace(0, 19, 6)])
    assert np.allclose([r.fit for r in got], [*(3 * (np.linspace(1000, 1199, 6) - 1000)), *(2 * np.linspace(0, 19, 6))])


def test_marginals(letters):
    assert C.marginal(letters, "n", "rug").count() == 4
    assert C.marginal(letters, "n", "histogram", nbins=2).columns[1] == "bin"
    assert C.marginal(letters, "n", "box").count() == 1
    assert C.marginal(letters, "n", "violin").count() == 50
    with pytest.raises(ValueError):
        C.marginal(letters, "n", "spiral")


def test_binned_density_is_within_its_bound(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(0, 1, 700), rng.normal(9, 0.3, 300)]).tolist() + [None, float("nan")]
    df = spark.createDataFrame([(v, "a" if i % 3 else None) for i, v in enumerate(values)], "v double, c string")
    h, bins = 0.4, 500
    exact = {(r.color, r.point): r.density for r in S.density(df, "v", "c", bandwidth=h).collect()}
    binned = S.density(df, "v", "c", bandwidth=h, bins=bins).collect()
    width = (max(values[:-2]) - min(values[:-2])) / (bins - 1)
    bound = ((width / h) ** 2 / 8 + np.exp(-S.CUT**2 / 2)) / (h * np.sqrt(2 * np.pi))
    assert len(binned) == len(exact) == 100
    assert max(abs(r.density - exact[r.color, r.point]) for r in binned) <= bound


def test_binned_density_of_one_value_and_of_none(spark):
    same = spark.createDataFrame([(4.0,)] * 3, "v double")
    got = [r.density for r in S.density(same, "v", points=3, bandwidth=2.0, bins=10).collect()]
    assert got == pytest.approx([1 / (2 * np.sqrt(2 * np.pi))] * 3)
    assert rows(S.density(same.where("v > 5"), "v", points=3, bandwidth=2.0, bins=10).where("density is not null")) == []
    with pytest.raises(ValueError):
        S.density(same, "v", bins=1)


def test_robust_line_ignores_outliers(spark):
    points = [(float(i), 2.0 * i + (i % 5) * 0.1, "a") for i in range(60)] + [(i + 0.5, 900.0, "a") for i in range(0, 60, 12)]
    # A line without any residual, a single place, and no colour.
    points += [(float(i), 3.0 * i, None) for i in range(10)] + [(5.0, 1.0, "one"), (5.0, 2.0, "one"), (None, 1.0, "a")]
    df = spark.createDataFrame(points, "x double, y double, c string")
    plain = {(r.color, r.point): r for r in S.lowess(df, "x", "y", "c", points=6, bandwidth=15.0).collect()}
    robust = {(r.color, r.point): r for r in S.lowess(df, "x", "y", "c", points=6, bandwidth=15.0, rounds=3).collect()}
    assert set(plain) == set(robust)
    assert all(abs(robust["a", i].fit - 2 * robust["a", i].x) < 1 for i in range(6))
    assert max(abs(plain["a", i].fit - 2 * plain["a", i].x) for i in range(6)) > 20
    assert all(robust[None, i].fit == pytest.approx(3 * robust[None, i].x) for i in range(6))
    assert robust["one", 0].fit == pytest.approx(1.5)


def test_capped_points_keep_every_region(spark):
    crowd = [(float(i % 10), float(i % 7), "red", i) for i in range(900)]
    lone = [(1000.0, 1000.0, "red", 2000), (0.0, 1000.0, "blue", 2001), (500.0, 3.0, None, 2002)]
    none = [(None, 1.0, "red", 3000), (1.0, float("nan"), "red", 3001)]
    df = spark.createDataFrame(crowd + lone + none, "turn double, digest double, color string, row int")
    kept = C.capped(df, ["turn", "digest"], 30, "color", "row", ["row"])
    assert kept.columns == ["turn", "digest", "color", "row"]
    got = {r.row for r in kept.collect()}
    assert len(got) == 30 and {2000, 2001, 2002} <= got and not got & {3000, 3001}
    assert {r.row for r in C.capped(df.repartition(7), ["turn", "digest"], 30, "color", "row", ["row"]).collect()} == got
    assert C.capped(df, ["turn"], 5000).count() == 903 + 1
    assert C.capped(df, ["turn", "digest"], 2, "color", "row").count() == 2
    assert C.capped(df.where("row < 0"), ["turn"], 5, "color").count() == 0
    assert C.scatter(df, "turn", "digest", most=10, key="row")["points"].count() == 10
    assert C.marginal(df, "turn", "rug", most=10, key="row").columns == ["value"]
    for wrong in (dict(axes=["color"], most=3), dict(axes=["turn"], most=0), dict(axes=["turn"] * 3, most=3)):
        with pytest.raises(ValueError):
            C.capped(df, **wrong)


def test_unmatched_phrases(spark):
    from reportweave.plans.structure import unmatched_phrases

    found = ("Unknown", "Unknown", "Unknown", None, "")
    answers = [("a big van", *found), ("A big, big VAN", "Waymo", "x", "2020", None, "car"), (None, *found), ("", *found),
               ("all found", "Waymo", "x", "2020", "Car", "car")]
    df = spark.createDataFrame(
        answers, "q2 string, q2_av_brand string, q2_av_model string, q2_av_year string,"
        " q2_other_road_user string, q2_other_vehicle string",
    )
    got = [tuple(r) for r in unmatched_phrases(df, top=3, longest=2).collect()]
    assert sorted(r for r in got if r[0] == "road_user") == [
        ("road_user", 1, "a", 2), ("road_user", 2, "a big", 2), ("road_user", 3, "big", 2)]
    assert sorted(r[1:] for r in got if r[0] == "brand") == [(1, "a", 1), (2, "a big", 1), (3, "big", 1)]
    assert {r[0] for r in got} == {"brand", "model", "year", "road_user", "vehicle"}
