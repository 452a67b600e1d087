"""Exact ranks and quantiles of columns of any length, within groups of any size.

A column's distinct values are counted, dealt to ranges of about equal size (a hot group spans many) and stored with their
range. Windows run inside a range; what lies before it is a prefix sum over ranges, a row each. No task and no aggregator
ever holds a whole column, group or set of distinct values."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored


def join_null_safe(left: DataFrame, right: DataFrame, groups: Sequence[str], keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on groups, where null equals null, and on keys; the left side's columns stay."""
    names = [*groups, *keys]
    right = right.withColumnsRenamed({c: f"_r_{c}" for c in names})
    same = [left[c].eqNullSafe(right[f"_r_{c}"]) for c in groups] + [left[c] == right[f"_r_{c}"] for c in keys]
    return left.join(right, same, how).drop(*(f"_r_{c}" for c in names))


def _before(sizes: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Of (groups, _part, _size): `_base`, the sizes of a group's earlier ranges, and `_total` of all."""
    own = Window.partitionBy(*groups)
    base = F.sum("_size").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select(*groups, "_part", F.coalesce(base, F.lit(0)).alias("_base"), F.sum("_size").over(own).alias("_total"))


def _ranges(df: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """(groups, value, _n, _part), stored: a row per distinct non-null value of a group, with its count and range."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
    return stored(counts.repartitionByRange(*groups, value).withColumn("_part", F.spark_partition_id()), "ranges")


def placed(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, value, _n, _part, _before, _total): rows of each distinct value, of the smaller ones in its group, and of the group."""
    ranges = _ranges(df, value, groups)
    offsets = _before(ranges.groupBy(*groups, "_part").agg(F.sum("_n").alias("_size")), groups)
    inner = Window.partitionBy(*groups, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranges.withColumn("_inner", F.coalesce(F.sum("_n").over(inner), F.lit(0)))
    return join_null_safe(rows, offsets, groups, ["_part"]).withColumn("_before", F.col("_base") + F.col("_inner")).drop("_base", "_inner")


def with_avg_rank(df: DataFrame, value: str, groups: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Ranks from 1 within each group; ties share their mean rank, null values have none.

    Rows fetch their value's rank by a join, whose skewed values Spark splits."""
    ranks = placed(df, value, groups).select(*groups, value, (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(out))
    return join_null_safe(df, ranks, groups, [value], "left")


def quantiles(df: DataFrame, value: str, shares: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """(groups, q): exact quantiles, linear between neighbours; null for a group without values. Without groups one row."""
    rows = placed(df, value, groups)
    place = [F.lit(float(s)) * (F.col("_total") - 1) for s in shares]
    holds = lambda i: (F.col("_before") <= i) & (i < F.col("_before") + F.col("_n"))
    at = lambda i: F.max(F.when(holds(i), F.col(value).cast("double")))
    picks = [c for k, h in enumerate(place) for c in (at(F.floor(h)).alias(f"_low{k}"), at(F.ceil(h)).alias(f"_high{k}"))]
    found = rows.groupBy(*groups).agg(F.max("_total").alias("_total"), *picks)
    between = [F.col(f"_low{k}") + (F.col(f"_high{k}") - F.col(f"_low{k}")) * (h - F.floor(h)) for k, h in enumerate(place)]
    return found.select(*groups, F.array(*between).alias("q"))


def fdr_bh(df: DataFrame, p: str, groups: Sequence[str] = (), out: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg q-values over the non-null p of each group; null where p is.

    Equal p share the value of their last rank. The least over all larger p is that of the range and of the later ranges."""
    rows = placed(df, p, groups).withColumn("_s", F.col(p) * F.col("_total") / (F.col("_before") + F.col("_n")))
    ends = rows.groupBy(*groups, "_part").agg(F.min("_s").alias("_least"))
    later = Window.partitionBy(*groups).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*groups, "_part", F.min("_least").over(later).alias("_later"))
    inner = Window.partitionBy(*groups, "_part").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    rows = join_null_safe(rows.withColumn("_inner", F.min("_s").over(inner)), ends, groups, ["_part"])
    q = rows.select(*groups, p, F.least(F.lit(1.0), "_inner", "_later").alias(out))
    return join_null_safe(df, q, groups, [p], "left")


def with_rank(df: DataFrame, order: Sequence, part: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Ranks from 1 in a declared order within each part. Rows that tie follow a hash of their columns, so a tie of any size is dealt to many ranges."""
    tie = F.xxhash64(*(c for c, t in df.dtypes if "map<" not in t and "variant" not in t))
    by = [*(F.col(c) if isinstance(c, str) else c for c in order), tie]
    ranges = stored(df.repartitionByRange(*part, *by).withColumn("_part", F.spark_partition_id()), "ranges")
    offsets = _before(ranges.groupBy(*part, "_part").agg(F.count("*").alias("_size")), part).drop("_total")
    inner = F.row_number().over(Window.partitionBy(*part, "_part").orderBy(*by))
    return join_null_safe(ranges.withColumn("_inner", inner), offsets, part, ["_part"]).withColumn(out, (F.col("_base") + F.col("_inner")).cast("bigint")).drop("_base", "_inner", "_part")
