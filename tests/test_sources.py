"""Files read and written, COCO tables, streams."""

import json

import pytest
from pyspark.sql import functions as F

from cellmorph.operators import pixels
from cellmorph.sources import coco, files
from cellmorph.streaming import ingest


def test_read_cells_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("cell_id,cell_area,scan_name,image_name\n1,10,s1,i1\n2,NaN,s1,i1\n")
    (tmp_path / "b.csv").write_text("scan_folder,image_name,cell_solidity,cell_id\ns2,i2,0.5,7\ns2,i2,NaN,8\n")
    rows = {(r.scan_name, r.cell_id): r for r in files.read_cells(spark, str(tmp_path)).collect()}
    assert set(rows) == {("s1", 1), ("s1", 2), ("s2", 7), ("s2", 8)}
    assert rows["s1", 1].cell_area == 10 and rows["s1", 1].cell_solidity is None
    assert rows["s2", 7].cell_solidity == 0.5 and rows["s2", 8].cell_solidity is None
    assert rows["s2", 7].source_file.endswith("b.csv")


def test_combine(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1), ("s1", 2), ("s2", 1)], "scan_name string, cell_id int")
    row = files.combine_results(df, str(tmp_path / "out")).first()
    assert (row.n_rows, row.n_scans) == (3, 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    with pytest.raises(ValueError):
        files.combine_results(df.limit(0), str(tmp_path / "none"))


def test_yolo_round_trip(spark, tmp_path):
    labels = tmp_path / "labels"
    labels.mkdir()
    (labels / "img1.txt").write_text("0 0.5 0.25 0.125 0.0625\n0 1 2\n0 a 1 1 1\n\n1 0.1 0.2 0.3 0.4")
    (labels / "empty.txt").write_text("")
    found = files.read_yolo_labels(spark, str(labels))
    assert sorted((r.image_name, r.cls, r.cx) for r in found.collect()) == [("img1", 0, 0.5), ("img1", 1, 0.1)]
    files.write_yolo_dataset(found, str(tmp_path / "set"))
    back = files.parse_yolo_lines(spark.read.text(str(tmp_path / "set/labels")).select("image_name", F.col("value").alias("line")))
    assert sorted((r.cls, r.cx, r.h) for r in back.collect()) == [(0, 0.5, 0.0625), (1, 0.1, 0.4)]


def test_inventory(spark, tmp_path):
    for root, names in (("img", ["s1/MG_whole/a.png", "s1/MG_whole/b.PNG", "s1/Dirt/c.txt"]), ("mask", ["s1/MG_whole/a.png"])):
        for n in names:
            p = tmp_path / root / n
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(b"x")
    rows = files.index_segmentations(spark, str(tmp_path / "img"), str(tmp_path / "mask")).collect()
    assert [(r["scan"], r["class"], r["file"], r["mask_path"] is not None) for r in rows] == [("s1", "MG_whole", "a.png", True), ("s1", "MG_whole", "b.PNG", False)]
    with pytest.raises(FileNotFoundError):
        (tmp_path / "void").mkdir()
        files.index_crops(spark, str(tmp_path / "void"))


def test_class_names(spark):
    a, b = files.class_names(spark, ["x", "y"]), files.class_names(spark, {1: "y", 0: "x"})
    files.assert_same_classes(a, b)
    with pytest.raises(ValueError):
        files.assert_same_classes(a, files.class_names(spark, ["x"]))


def test_weights_and_curve(spark, tmp_path):
    (tmp_path / "w.csv").write_text("feature,weight\na,0.5\n")
    assert files.read_weights(spark, str(tmp_path / "w.csv")).collect() == [("a", 0.5)]
    (tmp_path / "bad.csv").write_text("feature,other\na,0.5\n")
    with pytest.raises(ValueError):
        files.read_weights(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "new.json").write_text(json.dumps({"averaged": [{"portion": 0.1, "map50": 0.5}], "raw": [{"portion": 0.1, "split_idx": 0}, {"portion": 0.1, "split_idx": 1}]}))
    (tmp_path / "old.json").write_text(json.dumps([{"portion": 0.1, "map50": 0.5}]))
    averaged, raw = files.read_learning_curve(spark, str(tmp_path / "new.json"))
    assert averaged.count() == 1 and raw.count() == 2
    averaged, raw = files.read_learning_curve(spark, str(tmp_path / "old.json"))
    assert averaged.count() == 1 and raw is None


def test_masks_written_as_runs(spark, tmp_path):
    px = spark.createDataFrame([("s", "c", 0, 0), ("s", "c", 1, 0), ("s", "c", 0, 2)], "scan string, class string, y int, x int")
    files.write_masks(px, str(tmp_path / "m"), 3, 3)
    row = spark.read.parquet(str(tmp_path / "m")).first()
    assert row["counts"] == [0, 2, 4, 1, 2] and row["value"] == 255
    back = pixels.rle_decode(spark.read.parquet(str(tmp_path / "m")).select("scan", "counts"), 3)
    assert sorted((r.y, r.x) for r in back.collect()) == [(0, 0), (0, 2), (1, 0)]


def test_coco_there_and_back(spark, tmp_path):
    name = "ann-{}__x-1_y-2_w-3_h-4__ds-1.png"
    index = spark.createDataFrame([("s_1", "MG_whole", name.format(2), 64, 64), ("s_1", "Dirt", name.format(1), 64, 64), ("s_0", "MG_whole", name.format(3), 64, 64), ("s_0", "MG_whole", "junk.png", 64, 64), ("s_0", "MG_whole", name.format(9), 64, 64)], "scan string, class string, file string, width int, height int")
    masks = index.where(~F.col("file").contains("ann-9")).select("scan", "class", "file", F.array(F.lit(5), F.lit(2)).alias("counts"), F.lit(2.0).alias("area"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(2.0)).alias("bbox"))
    rows = coco.to_coco(index, masks).orderBy("image.id").collect()
    assert [(r.image.id, r.image.original_scan, r.annotation.category_id, r.category.name) for r in rows] == [(1, "s_0", 1, "MG_whole"), (2, "s_1", 2, "Dirt"), (3, "s_1", 1, "MG_whole")]
    doc = {"images": [r.image.asDict(True) for r in rows], "annotations": [r.annotation.asDict(True) for r in rows], "categories": []}
    for image in doc["images"][:1]:
        for k in ("original_scan", "original_class", "original_coords", "downsample"):
            image.pop(k)
    (tmp_path / "c.json").write_text(json.dumps(doc))
    images, annotations, _ = coco.read_coco(spark, str(tmp_path / "c.json"))
    found = coco.coco_to_index(images, annotations).orderBy("image_id").collect()
    assert [(r["scan"], r["class"], r["file"], r["x"], r["h"], r["ds"]) for r in found] == [("s_0", "MG_whole", name.format(3), 1, 4, 1), ("s_1", "Dirt", name.format(1), 1, 4, 1), ("s_1", "MG_whole", name.format(2), 1, 4, 1)]


def test_stream_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "scan_name STRING, image_name STRING, global_cell_id STRING, cell_area DOUBLE"
    (tmp_path / "in/a.csv").write_text("scan_name,image_name,global_cell_id,cell_area\ns1,i,c1,1\ns1,i,c2,2\n")
    run = lambda: ingest.stream_results(ingest.read_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    (tmp_path / "in/b.csv").write_text("scan_name,image_name,global_cell_id,cell_area\ns1,i,c2,2\ns2,i,c1,3\n")
    run()
    run()
    assert sorted((r.scan_name, r.global_cell_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("s1", "c1"), ("s1", "c2"), ("s2", "c1")]
