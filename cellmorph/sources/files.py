"""Readers, writers and inventories of result files, labels and images."""

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, stem
from ..schema import CELLS, nan_to_null, require

IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp")


def read_cells(spark: SparkSession, *paths: str, schema: str = CELLS, keep: Sequence[str] = ()) -> DataFrame:
    """Result files stacked by column name; the older scan_folder is scan_name; source_file is added.

    A multi-file CSV read aligns columns by position, so files are grouped by their header line first: headers
    are read as the first lines of the files, one row per file."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", F.substring_index(F.decode(F.substring("content", 1, 65536), "UTF-8"), "\n", 1).alias("header"))
    groups = listed.groupBy(F.trim(F.regexp_replace("header", "\r", "")).alias("header")).agg(F.collect_list("path").alias("paths")).collect()
    if not groups:
        raise FileNotFoundError(f"no result files in {', '.join(paths)}")
    kinds = dict(part.strip().split(" ") for part in schema.split(","))
    frames = []
    for g in groups:
        names = [c.strip().strip('"') for c in g["header"].split(",")]
        fields = ", ".join(f"`{c}` {kinds.get('scan_name' if c == 'scan_folder' else c, 'STRING')}" for c in names)
        df = spark.read.csv(g["paths"], header=True, schema=fields, enforceSchema=True).withColumn("source_file", F.col("_metadata.file_path"))
        df = df.withColumnRenamed("scan_folder", "scan_name")
        frames.append(df.select(*(c for c in df.columns if c in kinds or c in keep or c == "source_file")))
    return nan_to_null(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames))


def combine_results(df: DataFrame, path: str) -> DataFrame:
    """Writes cells as Parquet by scan; returns one row (n_rows, n_scans, n_files). An error without rows, which leaves the folder empty.

    The input is evaluated once: the write counts its rows, scans and files are counted in what it wrote (folder names and one column)."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n_rows")).write.mode("overwrite").partitionBy("scan_name").parquet(path)
    n = seen.get["n_rows"]
    if not n:
        raise ValueError("no result rows to combine")
    files = F.count_distinct("source_file") if "source_file" in df.columns else F.lit(None).cast("long")
    return df.sparkSession.read.parquet(path).agg(F.lit(n).cast("long").alias("n_rows"), F.count_distinct("scan_name").alias("n_scans"), files.alias("n_files"))


def parse_yolo_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """cls, cx, cy, w, h of lines with exactly five numbers; others go."""
    parts = F.split(F.trim(F.col(line)), r"\s+")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    rows = lines.where(F.size(parts) == 5).withColumns({"cls": number(0).cast("int"), **{c: number(i + 1) for i, c in enumerate(("cx", "cy", "w", "h"))}})
    return rows.dropna(subset=["cls", "cx", "cy", "w", "h"])


def read_yolo_labels(spark: SparkSession, path: str, image: Callable[[Column], Column] = stem) -> DataFrame:
    """(image_name, line_no, cls, cx, cy, w, h) of label files below a path; none without files. `image` makes the name of the file's path."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    rows = lines.select(image(F.col("_metadata.file_path")).alias("image_name"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return parse_yolo_lines(rows).drop("line")


def yolo_lines(boxes: DataFrame, image: str = "image_name") -> DataFrame:
    """(image, text): one label text per image, lines in a fixed order."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", F.col("cls").cast("int"), *(F.bround(c, 6) for c in ("cx", "cy", "w", "h")))
    return boxes.groupBy(image).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))


def write_yolo_dataset(boxes: DataFrame, path: str, names: Sequence[str] = ("Microglia",), image: str = "image_name") -> DataFrame:
    """Label texts in a folder per image, the manifest of images, the class names; returns the manifest, as it was written."""
    yolo_lines(boxes, image).repartition(image).write.mode("overwrite").partitionBy(image).text(f"{path}/labels")
    boxes.select(F.concat(F.lit("images/"), F.col(image)).alias("value")).distinct().orderBy("value").coalesce(1).write.mode("overwrite").text(f"{path}/train")
    classes = boxes.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string")
    classes.coalesce(1).write.mode("overwrite").json(f"{path}/classes")
    return boxes.sparkSession.read.text(f"{path}/train")


def list_files(spark: SparkSession, root: str, extensions: Sequence[str] = IMAGES) -> DataFrame:
    """(path, length) below a root; contents are never selected, so never read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return found.where(F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).isin(*extensions))


def index_segmentations(spark: SparkSession, root: str, mask_root: str | None = None, extensions: Sequence[str] = IMAGES) -> DataFrame:
    """(scan, class, file, image_path, mask_path) of root/scan/class/file, masks matched by the same place."""
    part = lambda i: F.element_at(F.split("path", "/"), -i)
    images = list_files(spark, root, extensions).select(part(3).alias("scan"), part(2).alias("class"), part(1).alias("file"), F.col("path").alias("image_path"))
    if mask_root is None:
        masked = images.withColumn("mask_path", F.lit(None).cast("string"))
    else:
        masks = list_files(spark, mask_root, extensions).select(part(3).alias("scan"), part(2).alias("class"), part(1).alias("file"), F.col("path").alias("mask_path"))
        masked = images.join(masks, ["scan", "class", "file"], "left")
    return masked.orderBy("scan", "class", "image_path")


def collect_images(spark: SparkSession, root: str, splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """(split, image_name, path) of the images below root/.../split/."""
    split = F.regexp_extract("path", rf"/({'|'.join(splits)})/(?:.*/)?[^/]*$", 1)
    return list_files(spark, root).select(split.alias("split"), base_name("path").alias("image_name"), "path").where("split <> ''")


def index_crops(spark: SparkSession, root: str) -> DataFrame:
    """(path) of unlabelled crops in order; an error without any."""
    found = list_files(spark, root).select("path").orderBy("path")
    if found.isEmpty():
        raise FileNotFoundError(f"no images below {root}")
    return found


def candidates(df: DataFrame, limit: int = 100_000, order: Sequence[str] = ("path",)) -> DataFrame:
    return df.orderBy(*order).limit(limit)


def class_names(spark: SparkSession, config: Sequence[str] | Mapping) -> DataFrame:
    """(id, name) of a list or a map of class names."""
    rows = [(int(k), v) for k, v in config.items()] if isinstance(config, Mapping) else list(enumerate(config))
    return spark.createDataFrame(rows, "id int, name string")


def assert_same_classes(a: DataFrame, b: DataFrame) -> None:
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ValueError("class names differ")


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """(feature, weight): a row per feature."""
    df = spark.read.csv(path, header=True)
    require(df, "feature", "weight")
    return df.select("feature", F.col("weight").cast("double").alias("weight"))


def read_learning_curve(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """(averaged, raw) of a results file; the old form, a plain list, has no raw rows."""
    df = spark.read.json(path, multiLine=True)
    if "averaged" not in df.columns:
        return df, None
    rows = lambda c: df.select(F.explode(c).alias("r")).select("r.*")
    return rows("averaged"), rows("raw") if "raw" in df.columns else None


def artifacts_by_tile(files: DataFrame, topics: Mapping[str, str], name: str = "path") -> DataFrame:
    """(tile, one column per topic with its first file): topics are recognised by their file names' endings."""
    out, file = F.lit(None), base_name(name)
    for suffix, topic in sorted(topics.items(), key=lambda kv: len(kv[0])):
        out = F.when(file.endswith(suffix), F.struct(F.lit(topic).alias("topic"), file.substr(F.lit(1), F.length(file) - len(suffix)).alias("tile"))).otherwise(out)
    rows = files.select(F.col(name).alias("file"), out.alias("t")).where("t is not null").select("file", "t.*")
    return rows.groupBy("tile").agg(*(F.min(F.when(F.col("topic") == t, F.col("file"))).alias(t) for t in dict.fromkeys(topics.values())))


def topic_counts(tiles: DataFrame) -> DataFrame:
    return tiles.agg(*(F.count(c).alias(c) for c in tiles.columns if c != "tile"))


def write_masks(px: DataFrame, path: str, height: int, width: int, by: Sequence[str] = ("scan", "class")) -> None:
    """Masks as run lengths, laid out by scan and class; set pixels mean 255."""
    from ..operators.pixels import rle_encode

    rle_encode(px, height, width).withColumns({"height": F.lit(height), "width": F.lit(width), "value": F.lit(255)}).write.mode("overwrite").partitionBy(*by).parquet(path)
