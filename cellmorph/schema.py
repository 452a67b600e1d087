"""Schemas and keys."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["scan_name", "image_name", "cell_id"]

# Feature columns in their order, and those that are whole numbers.
FEATURES = (
    "skeleton_length num_junctions num_components num_end_nodes num_start_nodes end_to_start_ratio total_nodes soma_area soma_perimeter soma_circularity cell_area cell_perimeter "
    "cell_convex_hull_area cell_convex_hull_perimeter cell_solidity cell_convexity cell_circularity cell_convex_circularity branch_area branch_perimeter "
    "sholl_min_radius sholl_peak_radius sholl_max_radius sholl_peak sholl_sum"
).split()
WHOLE = frozenset(
    "skeleton_length num_junctions num_components num_end_nodes num_start_nodes total_nodes soma_area cell_area branch_area sholl_min_radius sholl_peak_radius sholl_max_radius sholl_peak sholl_sum".split()
)

CELLS = ", ".join(["cell_id INT", *(f"{f} {'INT' if f in WHOLE else 'DOUBLE'}" for f in FEATURES), "xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE, image_name STRING, scan_name STRING, global_cell_id STRING"])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is missing everywhere: aggregates and joins then skip it."""
    return df.select(*(F.nanvl(c, F.lit(None)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
