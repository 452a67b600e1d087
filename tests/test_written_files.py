"""What queries write between their steps."""

import shutil

from pyspark.sql import functions as F

from cellmorph import queries
from cellmorph.sources import files


def test_coco_documents_are_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "new_path", lambda spark, tag: str(tmp_path / tag))
    assert queries.QUERIES["s5_read_coco"](spark, "/root/testdata/sf0.001").count() > 0
    written = list((tmp_path / "documents").glob("part-*"))
    assert written and all(f.name.endswith(".gz") for f in written)


def test_yolo_manifest_is_the_written_one(spark, tmp_path):
    path = str(tmp_path / "boxes")
    spark.createDataFrame([("b", 0, 0.5, 0.5, 0.1, 0.1), ("a", 0, 0.2, 0.2, 0.1, 0.1), ("b", 1, 0.3, 0.3, 0.1, 0.1)], "image_name string, cls int, cx double, cy double, w double, h double").write.parquet(path)
    manifest = files.write_yolo_dataset(spark.read.parquet(path), str(tmp_path / "set"))
    shutil.rmtree(path)  # the boxes are not made again
    assert [r[0] for r in manifest.collect()] == ["images/a", "images/b"]
    named = files.read_yolo_labels(spark, str(tmp_path / "set" / "labels"), lambda file: files.F.regexp_extract(file, "image_name=([^/]*)/", 1))
    assert sorted((r["image_name"], r["line_no"], r["cls"]) for r in named.collect()) == [("a", 0, 0), ("b", 0, 0), ("b", 1, 1)]


def test_coco_tables_are_packed_and_rows_stored_once(spark, tmp_path, monkeypatch):
    from cellmorph.sources import coco
    from cellmorph.tables import discard

    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    name = F.concat(F.lit("ann-"), F.col("id"), F.lit("__x-1_y-2_w-3_h-4__ds-1.png"))
    index = spark.range(40).mapInArrow(seen, "id long").select(F.lit("s").alias("scan"), F.lit("Dirt").alias("class"), name.alias("file"), F.lit(3).alias("width"), F.lit(4).alias("height"))
    masks = spark.range(40).select(F.lit("s").alias("scan"), F.lit("Dirt").alias("class"), name.alias("file"), F.array(F.lit(1)).alias("counts"), F.lit(1.0).alias("area"), F.array(F.lit(0.0)).alias("bbox"))
    monkeypatch.setattr(coco, "FILE_ROWS", 15)
    rows = coco.to_coco(index, masks)
    coco.write_coco(rows, str(tmp_path))
    assert made.value == 40  # counts per class read what is stored
    written = [f for n in ("images", "annotations") for f in (tmp_path / n).glob("part-*")]
    assert len(written) >= 6 and all(f.name.endswith(".json.gz") for f in written)
    assert sorted(r["id"] for r in spark.read.json(f"{tmp_path}/images").collect()) == list(range(1, 41))
    discard(rows)
