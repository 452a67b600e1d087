"""Means of scans that hold the same values are equal, whatever the order and number of their rows."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cellmorph.operators.aggregates import scan_level


def test_means_do_not_depend_on_order_or_copies(spark):
    rng = random.Random(2)
    values = [rng.choice((0.1, 1e3, 1e6)) * rng.random() for _ in range(999)]
    rows = [(f"s{k}", x) for k in range(12) for x in rng.sample(values, len(values)) * (1 + k % 3)]
    df = spark.createDataFrame(rows, "scan_name string, v double").repartition(7, F.rand(1)).withColumn("cell_id", F.lit(1))
    means = {r["v"] for r in scan_level(df, ["v"]).collect()}
    assert len(means) == 1 and means.pop() == pytest.approx(float(sum(map(Fraction, values)) / len(values)), rel=1e-15)


def test_means_of_odd_values(spark):
    nan = float("nan")
    rows = [("a", 1.0, 3), ("a", None, 4), ("b", None, None), ("c", nan, 1), ("c", 1.0, 1), ("d", float("inf"), 0), ("e", 0.0, -1), ("f", -5e-324, 2)]
    df = spark.createDataFrame(rows, "scan_name string, v double, n int").withColumn("cell_id", F.lit(1))
    got = {r["scan_name"]: (r["v"], r["n"]) for r in scan_level(df, ["v", "n"]).collect()}
    assert got["c"][0] != got["c"][0] and {k: x for k, x in got.items() if k != "c"} == {"a": (1.0, 3.5), "b": (None, None), "d": (float("inf"), 0.0), "e": (0.0, -1.0), "f": (0.0, 2.0)}
