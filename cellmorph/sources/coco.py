"""COCO annotation files as tables."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import parse_ann_name, parse_flat_name
from ..tables import discard, stored

SCHEMA = """
images array<struct<id long, file_name string, width int, height int, original_scan string, original_class string,
  original_coords struct<x int, y int, width int, height int>, downsample int>>,
annotations array<struct<id long, image_id long, category_id int, segmentation string, area double, bbox array<double>, iscrowd int>>,
categories array<struct<id int, name string, supercategory string>>
"""
#: Rows of a packed file, which one task reads.
FILE_ROWS = 500_000
CLASSES = ("MG_whole", "MG_cell_body", "Cluster", "Unclassified", "Dirt", "microglia")


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories); segmentations stay JSON text, as they are runs or polygons."""
    doc = spark.read.schema(SCHEMA).json(path, multiLine=True)
    rows = lambda c: doc.select(F.explode(c).alias("r")).select("r.*")
    return rows("images"), rows("annotations"), rows("categories")


def to_coco(index: DataFrame, masks: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """One row per image (image, annotation, category structs) with dense ids.

    index: scan, class, file, width, height; masks: scan, class, file, counts, area, bbox. Images are numbered
    in the order of scan, class and file, categories by first appearance in it. Images without a mask or a
    name that parses go. Ranks over all images come from counts per class first, then ranks within: rows are made, shuffled and
    stored once with the latter (`discard` the result when it has been read), and names are parsed again after it."""
    both = index.where(~F.col("class").isin(*exclude)).join(masks, ["scan", "class", "file"])
    # Names that don't parse go after the ranks, in which they don't count: a filter that Spark pushes into one table alone would
    # keep two tables made of the same rows from sharing their shuffle.
    named, inner = parse_ann_name("file").isNotNull(), Window.partitionBy("scan", "class").orderBy("file")
    rows = stored(both.withColumn("_place", F.count(F.when(named, 1)).over(inner.rowsBetween(Window.unboundedPreceding, 0))).where(named), "images")
    sizes = rows.groupBy("scan", "class").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(F.lit(0)).orderBy("scan", "class")  # a row per scan and class, broadcast
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = sizes.groupBy("class").agg(F.min(F.struct("scan", "class")).alias("f"))
    first = first.withColumn("category_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("f"))).drop("f")
    n = rows.join(F.broadcast(sizes), ["scan", "class"]).join(F.broadcast(first), "class").withColumn("id", F.col("before") + F.col("_place")).withColumn("name", parse_ann_name("file"))
    coords = F.struct(F.col("name.x").alias("x"), F.col("name.y").alias("y"), F.col("name.w").alias("width"), F.col("name.h").alias("height"))
    image = F.struct("id", F.concat_ws("_", "scan", "class", "file").alias("file_name"), "width", "height", F.col("scan").alias("original_scan"), F.col("class").alias("original_class"), coords.alias("original_coords"), F.col("name.ds").alias("downsample"))
    runs = F.struct("counts", F.array("height", "width").alias("size"))
    annotation = F.struct("id", F.col("id").alias("image_id"), "category_id", runs.alias("segmentation"), "area", "bbox", F.lit(0).alias("iscrowd"))
    category = F.struct(F.col("category_id").alias("id"), F.col("class").alias("name"), F.lit("microglia").alias("supercategory"))
    out = n.select(image.alias("image"), annotation.alias("annotation"), category.alias("category"))
    out._stored_path = rows._stored_path
    return out


def write_coco(rows: DataFrame, path: str) -> None:
    """The three tables as JSON lines in folders of their own, packed by gzip in files of FILE_ROWS: no document is gathered on one machine.
    The rows are made once, and stored until all are written."""
    rows = stored(rows, "coco")
    for name, part in (("images", rows.select("image.*")), ("annotations", rows.select("annotation.*")), ("categories", rows.select("category.*").distinct())):
        part.write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).json(f"{path}/{name}")
    discard(rows)


def coco_to_index(images: DataFrame, annotations: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    """(scan, class, file, x, y, w, h, ds, image_id, annotation_id): nested facts, else those of the file name.

    The first annotation of an image counts; images without one go. Names are parsed after the join, so that it moves no parts of them."""
    first = annotations.groupBy("image_id").agg(F.min("id").alias("annotation_id"))
    own = lambda nested, named, out: F.coalesce(nested, named).alias(out)
    rows = images.join(first, images["id"] == first["image_id"])
    rows = rows.withColumn("flat", parse_flat_name("file_name", classes)).withColumn("name", parse_ann_name(F.col("flat.ann_name")))
    return rows.select(
        own(F.col("original_scan"), F.col("flat.scan"), "scan"), own(F.col("original_class"), F.col("flat.class"), "class"), F.coalesce("flat.ann_name", "file_name").alias("file"),
        *(own(F.col(f"original_coords.{a}"), F.col(f"name.{b}"), b) for a, b in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))), own(F.col("downsample"), F.col("name.ds"), "ds"), "image_id", "annotation_id",
    )
