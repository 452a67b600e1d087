"""First and central rows, numbering, order, limits and set operations (W1-W4, O1-O3, U1-U4). Ranks are in `order`."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key in a declared order. Groups are cut to one row before they are shuffled."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def number_cells(df: DataFrame, image: Sequence[str], order: Sequence) -> DataFrame:
    return df.withColumn("number", (F.row_number().over(Window.partitionBy(*image).orderBy(*order)) - 1).cast("bigint"))


def central_cells(df: DataFrame, cluster: str, cols: Sequence[str], n: int, key: str, existing: DataFrame | None = None) -> DataFrame:
    """The n cells nearest to their cluster's mean, of those whose image exists, with rank and distance."""
    rows = df.dropna(subset=[cluster, *cols])
    centres = rows.groupBy(cluster).agg(*(F.avg(c).alias(f"_m_{c}") for c in cols))
    if existing is not None:
        rows = rows.join(existing, existing.columns, "left_semi")
    square = sum(((F.col(c) - F.col(f"_m_{c}")) * (F.col(c) - F.col(f"_m_{c}")) for c in cols), F.lit(0.0))
    near = rows.join(centres, cluster).withColumn("distance", F.sqrt(square)).drop(*(f"_m_{c}" for c in cols))
    order = Window.partitionBy(cluster).orderBy("distance", key)
    return near.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= n)


def label_examples(df: DataFrame, label: str, n: int, order: Sequence[str], existing: DataFrame | None = None) -> DataFrame:
    """The first n rows of each label, and how many the label has."""
    rows = df.where(F.col(label).isNotNull())
    if existing is not None:
        rows = rows.join(existing, existing.columns, "left_semi")
    totals = rows.groupBy(label).agg(F.count("*").alias("total"))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy(*order)).cast("bigint")).where(F.col("rank") <= n)
    return first.join(totals, label)


def top_n(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def order_results(df: DataFrame, *spec: tuple[str, str]) -> DataFrame:
    """Sorted by (column, how), how being asc, desc or abs; nulls last."""
    how = {"asc": lambda c: F.asc_nulls_last(c), "desc": lambda c: F.desc_nulls_last(c), "abs": lambda c: F.abs(F.col(c)).desc_nulls_last()}
    return df.orderBy(*(how[h](c) for c, h in spec))


def argmax_row(df: DataFrame, value: str, key: str) -> DataFrame:
    """The row of the largest value, the smallest key on ties; aggregated, not sorted."""
    return df.where(F.col(value).isNotNull()).agg(F.max_by(F.struct(*df.columns), F.struct(F.col(value), -F.col(key))).alias("r")).select("r.*")


def stack(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_additional(train: DataFrame, extra: DataFrame, name: str) -> DataFrame:
    """Primary and additional rows; names may not repeat within or between them."""
    from .aggregates import duplicates
    from .joins import assert_no_overlap

    assert_no_overlap(train, extra, name)
    for part in (train, extra):
        if found := duplicates(part, [name]).limit(5).collect():
            raise ValueError(f"repeated names: {', '.join(str(r[0]) for r in found)}")
    return train.unionByName(extra)


def key_diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_anti")


def key_intersect(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def distinct_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()
