"""Whole analyses made of operators."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import aggregates, filters


def clean_cells(cells: DataFrame, features: Sequence[str] = ("cell_solidity",), area: str = "cell_area") -> DataFrame:
    """Complete cells without size outliers, away from tile borders."""
    return filters.drop_border(filters.drop_outliers(filters.complete_cases(cells, features), area))


def composition_by_diagnosis(cells: DataFrame, scans: DataFrame, cluster: str = "cluster", least: int | None = None) -> DataFrame:
    """(diagnosis_group, scan_name, cluster, p, n_cells): cluster shares of the scans that are large enough."""
    kept, _, _ = aggregates.drop_small_scans(clean_cells(cells), least)
    props = aggregates.composition_long(kept, cluster)
    return props.join(scans.select("scan_name", "diagnosis_group"), "scan_name").select("diagnosis_group", "scan_name", "cluster", "p", "n_cells")


def pathology(scans: DataFrame) -> DataFrame:
    """Scans with their A, B and C scores, intensity, combined string and pathology group."""
    scored = scans.withColumns({"a_score": text.a_score(text.max_number("thal_stage")), "b_score": text.b_score("braak_stage"), "c_score": text.c_score("cerad_score")})
    scored = scored.withColumns({"abc": text.abc_string("a_score", "b_score", "c_score"), "intensity": text.ad_intensity("a_score", "b_score", "c_score")})
    return scored.withColumn("pathology_group", text.pathology_group("diagnosis_group", "intensity"))


def confidence_queue(det: DataFrame, low: float = 0.45, high: float = 0.55, n: int = 100) -> DataFrame:
    """Boxes of the first n images with a doubtful box, with how many each image has."""
    boxes = filters.band_review(det, low, high, n)
    return boxes.join(boxes.groupBy("scan_name", "image_name").agg(F.count("*").alias("n_boxes")), ["scan_name", "image_name"])
