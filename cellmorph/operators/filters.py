"""Filters and row predicates."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import quantiles, with_rank


def drop_border(df: DataFrame, tile: int = 512) -> DataFrame:
    """Cells that touch no border of their tile."""
    return df.where((F.col("xmin") > 1) & (F.col("ymin") > 1) & (F.col("xmax") < tile - 1) & (F.col("ymax") < tile - 1))


def drop_outliers(df: DataFrame, col: str, low: float = 0.002, high: float = 0.998) -> DataFrame:
    """Rows between two exact quantiles (inclusive, interpolated). The bounds are one row, so they are broadcast."""
    bounds = quantiles(df, col, [low, high]).select(F.col("q").alias("_q"))
    return df.crossJoin(F.broadcast(bounds)).where(F.col(col).between(F.col("_q")[0], F.col("_q")[1])).drop("_q")


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(how="any", subset=list(cols))


def above(df: DataFrame, threshold: float = 0.5, col: str = "conf") -> DataFrame:
    return df.where(F.col(col) > threshold)


def band_review(det: DataFrame, low: float, high: float, max_images: int | None = None, image=("scan_name", "image_name")) -> DataFrame:
    """Boxes above `low` of images that have any box within (low, high); the first images by name if limited."""
    keys = list(image)
    chosen = det.where((F.col("conf") > low) & (F.col("conf") < high)).select(*keys).distinct()
    if max_images is not None:
        chosen = chosen.orderBy(*keys).limit(max_images)
    return det.where(F.col("conf") > low).join(chosen, keys, "left_semi")


def diagnosis_group(name, ad_pattern: str = "ad", ad_ids: Sequence[str] = ()) -> Column:
    """AD by a pattern in the name or by a listed id, else 100+; a null name is 100+."""
    name = F.col(name)
    return F.when(F.coalesce(F.lower(name).contains(ad_pattern) | name.isin(*ad_ids), F.lit(False)), "AD").otherwise("100+")


def two_groups(df: DataFrame, col: str, a: str, b: str) -> DataFrame:
    """Rows of two groups; an error if either is empty."""
    out = df.where(F.col(col).isin(a, b))
    found = {r[0] for r in out.select(col).distinct().collect()}
    if missing := {a, b} - found:
        raise ValueError(f"empty groups: {', '.join(sorted(missing))}")
    return out


def annotated(df: DataFrame, col: str, ignore: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col(col).isNotNull() & ~F.col(col).isin(*ignore))


def exclude(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    """Rows whose value is not listed; rows without a value stay."""
    return df.where(~F.coalesce(F.col(col).isin(*values), F.lit(False)))


def valid_box(df: DataFrame, least: float = 0) -> DataFrame:
    return df.where((F.col("xmax") - F.col("xmin") > least) & (F.col("ymax") - F.col("ymin") > least))


def with_cell_id(df: DataFrame) -> DataFrame:
    return df.withColumn("global_cell_id", F.concat("image_name", F.lit("_cell_"), F.col("cell_id").cast("string")))


def mask_quality(index: DataFrame, grades: DataFrame, order: Sequence[str], default: str = "good") -> DataFrame:
    """Grades (pos, grade, priority) by position in the declared order; the highest priority wins, else default."""
    placed = with_rank(index, order, out="pos").withColumn("pos", F.col("pos") - 1)
    best = grades.groupBy("pos").agg(F.max_by("grade", "priority").alias("mask_quality"))
    return placed.join(best, "pos", "left").withColumn("mask_quality", F.coalesce("mask_quality", F.lit(default)))


def typed_columns(df: DataFrame, cols: Sequence[str], least: int = 2) -> DataFrame:
    """(column, kind): numeric where at least `least` values are numbers, else categorical; in one pass."""
    counts = df.agg(*(F.count(F.col(c).cast("string").try_cast("double")).alias(c) for c in cols))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.when(F.col(c) >= least, "numeric").otherwise("categorical").alias("kind")) for c in cols)))
    return counts.select(pairs.alias("p")).select("p.*")


def unusable(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, reason) of columns that hold nothing or a single value; in one pass."""
    stats = df.agg(*(F.struct(F.count(c).alias("n"), F.count_distinct(c).alias("d")).alias(c) for c in cols))
    reason = lambda c: F.when(F.col(f"{c}.n") == 0, "all missing").when(F.col(f"{c}.d") <= 1, "constant")
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), reason(c).alias("reason")) for c in cols)))
    return stats.select(pairs.alias("p")).select("p.*").where("reason is not null")


def drop_unusable(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*(r["feature"] for r in unusable(df, cols).collect()))


def cluster_columns(df: DataFrame, prefix: str) -> list[str]:
    """Columns of a prefix in the order of their numeric suffix."""
    found = [c for c in df.columns if c.startswith(prefix)]
    if not found:
        raise ValueError(f"no column starts with {prefix}")
    return sorted(found, key=lambda c: int(c.rpartition("_")[2]))


def normalise_composition(df: DataFrame, cols: Sequence[str], eps: float = 1e-6) -> DataFrame:
    """Parts clipped to [eps, 1] and scaled to sum 1."""
    clipped = {c: F.least(F.greatest(F.col(c).cast("double"), F.lit(eps)), F.lit(1.0)) for c in cols}
    total = sum(list(clipped.values())[1:], clipped[cols[0]])
    return df.withColumns({c: v / total for c, v in clipped.items()})
