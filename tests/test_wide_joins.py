"""Cells meet whole: features part after the join, and a COCO table is made once for its three files."""

from pyspark.sql import functions as F

from cellmorph.operators.aggregates import morphology_score
from cellmorph.operators.pixels import morphology_similarity
from cellmorph.sources import coco


def test_features_part_after_the_join(spark):
    cells = spark.createDataFrame([(1, 10.0, 2.0), (2, 0.0, 3.0), (3, 5.0, None)], "cell long, cell_area double, length double")
    weights = spark.createDataFrame([("cell_area", 1.0), ("length", 3.0)], "feature string, weight double")
    scored = morphology_score(cells, cells, weights, ["cell_area", "length"], ["cell"])
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    similar = morphology_similarity(cells.where("cell <> 1"), cells, weights, ["cell_area", "length"], ["cell"])
    assert similar._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    assert {r["cell"]: round(r["score"], 6) for r in similar.collect()} == {1: 0.0, 2: 0.0, 3: 0.25}


def test_coco_rows_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(5).mapInArrow(seen, "id long").select(F.struct("id").alias("image"), F.struct("id").alias("annotation"), F.struct(F.lit(1).alias("id")).alias("category"))
    coco.write_coco(rows, str(tmp_path))
    assert made.value == 5
    assert [spark.read.json(f"{tmp_path}/{n}").count() for n in ("images", "annotations", "categories")] == [5, 5, 1]
