"""Pixels that come from few bytes: Spark's size estimate is far too small, so no join may broadcast them."""

import pytest
from pyspark.sql import functions as F

from cellmorph.fixtures import DEALT, Tables
from cellmorph.operators import pixels as px


@pytest.fixture(scope="module")
def masks(spark, tmp_path_factory):
    """Whole masks and somas: squares exploded from a row per mask."""
    path = str(tmp_path_factory.mktemp("parts") / "parts")
    spark.range(30).write.parquet(path)
    square = lambda n: F.explode(F.expr(f"flatten(transform(sequence(1L, {n}L), a -> transform(sequence(1L, {n}L), b -> struct(a as y, b as x))))"))
    of = lambda n: spark.read.parquet(path).select(F.col("id").alias("cell_id"), square(n).alias("p")).select("cell_id", "p.*")
    return of(9), of(4)


@pytest.mark.parametrize(
    "made",
    [
        lambda w, s: px.branch_mask(w, s), lambda w, s: px.process_skeleton(w, s), lambda w, s: px.neighbours(w), lambda w, s: px.neighbour_count(w), lambda w, s: px.end_nodes(w, s), lambda w, s: px.start_nodes(w, s),
        lambda w, s: px.sholl(w, s), lambda w, s: px.otsu_mask(w.withColumn("gray", F.col("x")), s), lambda w, s: px.confident_crops(w.withColumn("p", F.lit(0.9))), lambda w, s: px.evaluate_regions(w, w, s),
    ],
)
def test_no_broadcast(masks, made):
    assert "Broadcast" not in made(*masks)._jdf.queryExecution().executedPlan().toString()


def test_less(masks):
    whole, soma = masks
    left = {tuple(r) for r in px.branch_mask(whole, soma).where("cell_id = 3").collect()}
    assert left == {(3, y, x) for y in range(1, 10) for x in range(1, 10) if y > 4 or x > 4}


def test_parts_are_dealt(spark, tmp_path):
    """A small file of parts is one split, whose pixels are made in many tasks."""
    n = 3 * DEALT
    spark.range(1, n + 1).select(F.col("id").alias("p_partkey"), F.lit(3).cast("int").alias("p_size")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    rows = Tables(spark, str(tmp_path)).fx_soma.groupBy(F.spark_partition_id().alias("t")).agg(F.count_distinct("cell_id").alias("n")).collect()
    assert len(rows) >= 4 and max(r["n"] for r in rows) < 1.2 * DEALT
