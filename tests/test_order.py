"""Ranks, quantiles and q-values by ranges against plain Python, with ties, nulls, hot groups and empty tables."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmorph.operators import filters, order, pixels, spatial, stats

ROWS = [(i, ("a", "b", None, "hot")[0 if i < 5 else 1 if i < 9 else 2 if i < 20 else 3], None if i % 17 == 0 else float((i * 7919) % 61) if i % 3 else 5.0) for i in range(400)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "k long, g string, v double").repartition(5)


def groups():
    out = collections.defaultdict(list)
    for _, g, v in ROWS:
        if v is not None:
            out[g].append(v)
    return out


def test_mean_ranks(df):
    by = groups()
    rank = lambda v, own: sum(o < v for o in own) + (sum(o == v for o in own) + 1) / 2
    got = {r["k"]: r["r"] for r in order.with_avg_rank(df, "v", ["g"], "r").collect()}
    assert got == {k: None if v is None else rank(v, by[g]) for k, g, v in ROWS}
    whole = [v for _, _, v in ROWS if v is not None]
    got = {r["k"]: r["rank"] for r in order.with_avg_rank(df, "v").collect()}
    assert got == {k: None if v is None else rank(v, whole) for k, _, v in ROWS}


def test_quantiles(df):
    shares = [0.0, 0.002, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r["q"] for r in order.quantiles(df, "v", shares, ["g"]).collect()}
    for g, own in groups().items():
        assert got[g] == pytest.approx(list(np.quantile(own, shares)))
    one = order.quantiles(df.where("g = 'zz'"), "v", [0.5]).collect()
    assert len(one) == 1 and one[0]["q"] == [None]
    kept = filters.drop_outliers(df, "v", 0.1, 0.9)
    low, high = np.quantile([v for _, _, v in ROWS if v is not None], [0.1, 0.9])
    assert {r["k"] for r in kept.collect()} == {k for k, _, v in ROWS if v is not None and low <= v <= high}
    assert "percentile" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_q_values(spark):
    p = [(i, "x" if i < 150 else None, None if i % 19 == 0 else ((i * 37) % 50) / 50) for i in range(200)]
    got = {r["k"]: r["q_value"] for r in order.fdr_bh(spark.createDataFrame(p, "k long, g string, p double"), "p", ["g"]).collect()}
    for g in ("x", None):
        own = sorted((v, k) for k, h, v in p if h == g and v is not None)
        low, want = 1.0, {}
        for place in range(len(own), 0, -1):
            low = min(low, own[place - 1][0] * len(own) / place)
            want[own[place - 1][1]] = low
        for k, h, v in p:
            if h == g:
                assert got[k] == (None if v is None else pytest.approx(want[k]))


def test_row_ranks(df):
    got = {r["k"]: r["rank"] for r in order.with_rank(df, [F.desc("v"), "k"]).collect()}
    assert got == {k: i for i, (_, k) in enumerate(sorted(((-np.inf if v is None else v) * -1, k) for k, _, v in ROWS), 1)}
    tied = order.with_rank(df, ["g"], out="place").collect()
    assert sorted(r["place"] for r in tied) == list(range(1, len(ROWS) + 1))
    parts = collections.defaultdict(list)
    for r in order.with_rank(df, ["k"], ["g"]).collect():
        parts[r["g"]].append((r["k"], r["rank"]))
    assert all([n for _, n in sorted(rows)] == list(range(1, len(rows) + 1)) for rows in parts.values())
    assert order.with_rank(df.limit(0), ["k"]).collect() == []


def test_no_window_over_a_whole_table(df):
    for out in (order.with_rank(df, ["k"]), order.with_avg_rank(df, "v")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        windows = [x for x in plan.split("\n") if "Window [" in x]
        assert windows and all("_part" in w for w in windows)


def test_kruskal_against_the_formula(spark, df):
    r = stats.kruskal(df.where("g is not null"), "v", "g").first()
    by = {g: v for g, v in groups().items() if g}
    whole = [v for own in by.values() for v in own]
    n = len(whole)
    rank = {v: sum(o < v for o in whole) + (sum(o == v for o in whole) + 1) / 2 for v in set(whole)}
    h = 12 / (n * (n + 1)) * sum(sum(rank[v] for v in own) ** 2 / len(own) for own in by.values()) - 3 * (n + 1)
    ties = sum(t**3 - t for t in collections.Counter(whole).values())
    assert r["h"] == pytest.approx(h / (1 - ties / (n**3 - n))) and r["n"] == n and r["n_groups"] == 3


def test_spans_equal_the_point_test(spark):
    rng = np.random.default_rng(3)
    shapes = {i: [(float(x), float(y)) for x, y in rng.integers(0, 25, (n, 2)) / (2 if i % 2 else 1)] for i, n in enumerate((3, 4, 7, 12, 30, 3, 2, 0))}
    shapes[50] = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    polygons = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in s]) for k, s in shapes.items()], "k long, polygon array<struct<x: double, y: double>>")
    grid = spark.range(-2, 30).withColumnRenamed("id", "y").crossJoin(spark.range(-2, 30).withColumnRenamed("id", "x"))
    want = polygons.crossJoin(grid).where(spatial.in_polygon(F.col("x") + 0.5, F.col("y") + 0.5, "polygon")).select("k", "y", "x")
    got = sorted(map(tuple, pixels.rasterize(polygons).collect()))
    assert got == sorted(map(tuple, want.collect())) and sum(k == 50 for k, *_ in got) == 100


def test_rings_cut_holes_and_many_corners(spark):
    box = lambda a, b: [{"x": x, "y": y} for x, y in ((a, a), (b, a), (b, b), (a, b))]
    circle = [{"x": 300 + 250 * float(np.cos(t)), "y": 300 + 250 * float(np.sin(t))} for t in np.linspace(0, 2 * np.pi, 5000, endpoint=False)]
    polygons = spark.createDataFrame([("ring", box(0.0, 20.0)), ("ring", box(5.0, 10.0)), ("circle", circle)], "k string, polygon array<struct<x: double, y: double>>")
    area = {r["k"]: r["area"] for r in pixels.mask_area(pixels.rasterize(polygons)).collect()}
    assert area["ring"] == 400 - 25 and area["circle"] == pytest.approx(np.pi * 250**2, rel=1e-3)
