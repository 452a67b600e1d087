"""Masks that are dealt by key stay where they are; pixels meet on a bitmap, not by shuffled copies of their neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmorph.fixtures import Tables
from cellmorph.operators import pixels as px

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("made", [lambda t: px.neighbours(t.fx_soma), lambda t: px.otsu_mask(t.fx_pixels.withColumn("gray", F.col("x")), t.fx_soma), lambda t: px.skeletonize(t.fx_pixels)])
def test_pixels_of_dealt_parts_are_not_shuffled(spark, made):
    plan = made(Tables(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan  # that of the parts
    assert not [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "REPARTITION_BY_NUM" not in line]


@pytest.mark.parametrize("conn", [4, 8])
def test_neighbours_across_tiles_signs_and_copies(spark, conn):
    rng = np.random.default_rng(2)
    places = {(int(y), int(x)) for y, x in zip(rng.integers(505, 520, 90), rng.integers(-6, 6, 90), strict=True)} | {(y, x) for y in range(1022, 1026) for x in range(510, 514)}
    rows = [(k, y, x) for k in ("a", "b") for y, x in sorted(places)] + [("a", 1023, 511), (None, 1, 1), (None, 1, 2), ("c", 1, None)]
    found = px.neighbours(spark.createDataFrame(rows, "k string, y int, x long"), conn)
    assert [t for _, t in found.dtypes] == ["string", "int", "bigint", "int", "bigint"]
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (conn == 8 or not (a and b))]
    want = [(k, y, x, y + a, x + b) for k, y, x in rows if k and x is not None for a, b in steps if (y + a, x + b) in places]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_otsu_mask_by_hand(spark):
    """Against the threshold operator and an opening by sets, with blue pixels, gray outside the annotation and annotation without a gray."""
    rng = np.random.default_rng(7)
    gray, marks = [], []
    for k in range(4):
        base = rng.integers(0, 256, (20, 20))
        base[3:12, 4:15] = rng.integers(0, 60, (9, 11))
        gray += [(k, y, x, int(base[y, x]), int(rng.integers(0, 180)), float(rng.random())) for y in range(20) for x in range(20) if rng.random() > 0.02]
        marks += [(k, y, x) for y in range(1, 22) for x in range(2, 18)]
    g = spark.createDataFrame(gray, "k long, y long, x long, gray int, hue int, saturation double")
    a = spark.createDataFrame([*marks, marks[0]], "k long, y int, x int")
    noted = set(marks)
    values = {(k, y, x): v if (k, y, x) in noted else 255 for k, y, x, v, *_ in gray}
    limit = {r["k"]: r["threshold"] for r in px.otsu_threshold(spark.createDataFrame([(p[0], v) for p, v in values.items()], "k long, g int"), ["k"]).collect()}
    dark = {p for p, v in values.items() if v <= limit[p[0]]}
    around = lambda p: {(p[0], p[1] + b, p[2] + c) for b in (-1, 0, 1) for c in (-1, 0, 1)}
    opened = {q for p in dark if around(p) <= dark for q in around(p)} & noted
    blue = {(k, y, x) for k, y, x, _, h, s in gray if 90 <= h <= 140 and s >= 0.1}
    plain = px.otsu_mask(g.drop("hue", "saturation"), a)
    assert plain.dtypes == a.dtypes and opened
    assert sorted(map(tuple, plain.collect())) == sorted(opened)
    assert sorted(map(tuple, px.otsu_mask(g, a).collect())) == sorted(opened - blue)
