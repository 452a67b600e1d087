"""Annotation and covariate joins."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import draw

from ..functions.text import extract_donor
from ..schema import require
from .ranking import keep_first


def join_expert_labels(cells: DataFrame, labels: DataFrame, on: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Labels onto cells, the first per key in the declared order, so that many cells meet one label at most."""
    require(cells, *on)
    require(labels, *on, *order)
    return cells.join(keep_first(labels, on, order).drop(*order), list(on), "left")


def join_covariates(cells: DataFrame, cohort: DataFrame, ids: Sequence[str], order: Sequence[str], id_col: str = "NBB") -> DataFrame:
    """Covariates by the donor id in the scan's name. A cohort has a row per donor, so its size settles the join."""
    once = keep_first(cohort.where(F.col(id_col).isNotNull() & (F.trim(id_col) != "")), [id_col], order)
    return cells.withColumn(id_col, extract_donor("scan_name", ids)).join(once, id_col, "left")


def attach_scan_scores(cells: DataFrame, scores: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per-scan scores onto cells in place of older copies."""
    return cells.drop(*cols).join(scores.select("scan_name", *cols), "scan_name", "left")


def join_summary_props(summary: DataFrame, props: DataFrame) -> DataFrame:
    """Summary and proportions per scan; columns both have are coalesced."""
    shared = [c for c in props.columns if c in summary.columns and c != "scan_name"]
    joined = summary.alias("s").join(props.alias("p"), "scan_name")
    return joined.select(
        "scan_name", *(F.coalesce(f"s.{c}", f"p.{c}").alias(c) if c in shared else F.col(f"s.{c}") for c in summary.columns if c != "scan_name"), *(F.col(f"p.{c}") for c in props.columns if c not in shared and c != "scan_name")
    )


def join_soma(index: DataFrame, paired: DataFrame) -> DataFrame:
    return index.join(paired.select("image_path", "soma_mask_path"), "image_path", "left")


def join_quality(index: DataFrame, quality: DataFrame) -> DataFrame:
    return index.join(quality.select("image_path", "mask_quality"), "image_path")


def pair_masks(index: DataFrame, whole: str = "MG_whole", soma: str = "MG_cell_body") -> DataFrame:
    """Whole-cell rows with the soma mask of the same file name in the same scan, if there is one."""
    w = index.where(F.col("class") == whole)
    s = index.where(F.col("class") == soma).select("scan", "file", F.col("mask_path").alias("soma_mask_path"))
    return w.join(s, ["scan", "file"], "left")


def cells_of_selected_images(cells: DataFrame, selected: DataFrame, image=("scan_name", "image_name")) -> DataFrame:
    return cells.join(selected.select(*image).distinct(), list(image), "left_semi")


def selected_cells(cells: DataFrame, selected: DataFrame, on=("scan_name", "global_cell_id")) -> DataFrame:
    return cells.join(selected.select(*on), list(on), "left_semi")


def flag_selected(cells: DataFrame, selected: DataFrame, on=("scan_name", "cell_id")) -> DataFrame:
    """All cells of the images that hold a selected one, and whether each is selected."""
    marks = selected.select(*on).distinct().withColumn("_hit", F.lit(1))
    flagged = cells_of_selected_images(cells, selected).join(marks, list(on), "left")
    return flagged.withColumn("selected", F.when(F.col("_hit").isNotNull(), 1).otherwise(0)).drop("_hit")


def rest_of(cells: DataFrame, sample: DataFrame, on: Sequence[str]) -> DataFrame:
    return cells.join(sample.select(*on), list(on), "left_anti")


def attach_image_label(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(stem, label) onto rows with a stem; rows without a label go."""
    return rows.join(labels, "stem")


def overlap(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    return a.select(on).distinct().join(b.select(on), on, "left_semi")


def assert_no_overlap(a: DataFrame, b: DataFrame, on: str) -> None:
    if found := overlap(a, b, on).limit(5).collect():
        raise ValueError(f"{on} in both tables: {', '.join(str(r[0]) for r in found)}")


def pairwise_distance(df: DataFrame, key: str, vector: str, limit: int = 1000) -> DataFrame:
    """(a, b, distance) of all pairs of a sample of up to `limit` rows (by a hash of key): a sampling operator, so bounded."""
    few = df.where(F.col(vector).isNotNull()).orderBy(draw([key], 0), key).limit(limit)
    left, right = few.select(F.col(key).alias("a"), F.col(vector).alias("_x")), few.select(F.col(key).alias("b"), F.col(vector).alias("_y"))
    square = F.aggregate(F.zip_with("_x", "_y", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    return left.crossJoin(right).where("a <> b").select("a", "b", F.sqrt(square).alias("distance"))
