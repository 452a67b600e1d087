"""Aggregations."""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import require
from .order import quantiles


def scans_per_group(df: DataFrame, group: str = "diagnosis_group") -> DataFrame:
    return df.groupBy(group).agg(F.count_distinct("scan_name").alias("n_scans"))


def even_means(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    """Aggregates {column: mean} that give the same for the same rows in any order and in any number of copies.

    Sums of doubles depend on the order in which Spark adds them, so that equal means differ in their last bit and rank apart.
    Here values are whole numbers of 2^-61 of the column's largest, whose sums are exact; a pass over df finds the largest."""
    doubles = [c for c, t in df.dtypes if c in cols and t in ("double", "float")]
    finite = {c: F.when(F.abs(c) < float("inf"), F.col(c).cast("double")) for c in doubles}
    most = df.agg(*(F.max(F.abs(v)).alias(c) for c, v in finite.items())).first() if doubles else {}

    def mean(c: str) -> Column:
        scale = 2.0 ** min(1023, 61 - math.frexp(most[c] or 1.0)[1])
        units = F.sum(F.rint(finite[c] * scale).cast("bigint").cast("decimal(20,0)"))
        even = F.call_function("div", units, F.nullif(F.count(finite[c]), F.lit(0)).cast("decimal(20,0)")).cast("double") / scale
        return F.when(F.count(c) > F.count(finite[c]), F.avg(c)).otherwise(even)

    return {c: mean(c) if c in doubles else F.avg(c) for c in cols}


def scan_level(df: DataFrame, features: Sequence[str], covariates: Sequence[str] = (), order: str = "cell_id") -> DataFrame:
    """One row per scan: feature means, and of each covariate the first non-null value in the declared order."""
    require(df, "scan_name", *features, *covariates)
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in covariates]
    named = df.where("scan_name is not null")
    return named.groupBy("scan_name").agg(*(m.alias(f) for f, m in even_means(named, features).items()), *first)


def inconsistent(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(scan_name, column, n_values) of covariates with several values in a scan, null counting as one."""
    counts = df.groupBy("scan_name").agg(*((F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in cols))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_values")) for c in cols)))
    return counts.select("scan_name", pairs.alias("p")).select("scan_name", "p.*").where("n_values > 1")


def scan_counts(df: DataFrame) -> DataFrame:
    """(scan_name, n_cells): the column n_cells where there is one, else rows counted."""
    named = df.where("scan_name is not null")
    if "n_cells" in df.columns:
        return named.where("n_cells is not null").groupBy("scan_name").agg(F.max("n_cells").cast("double").alias("n_cells"))
    return named.groupBy("scan_name").agg(F.count("*").cast("double").alias("n_cells"))


def drop_small_scans(df: DataFrame, least: int | None = None, bottom: float = 0.1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of large scans, counts, a row with the threshold and the number of scans removed).

    The threshold is `least`, or the `bottom` quantile of the scans' counts."""
    counts = scan_counts(df)
    limit = counts.agg(F.lit(float(least)).alias("threshold")) if least is not None else quantiles(counts, "n_cells", [bottom]).select(F.col("q")[0].alias("threshold"))
    judged = counts.crossJoin(F.broadcast(limit)).withColumn("kept", F.col("n_cells") >= F.col("threshold"))
    kept = df.join(judged.where("kept").select("scan_name"), "scan_name", "left_semi")
    return kept, counts, judged.agg(F.max("threshold").alias("threshold"), F.count_if(~F.col("kept")).alias("removed"))


def cluster_props(df: DataFrame, cluster: str, values: Sequence, prefix: str = "hard_cluster_") -> DataFrame:
    """Wide proportions of the clusters per scan, 0 where a cluster is absent, and n_cells.

    One pass of conditional counts over the named values."""
    rows = df.where(F.col("scan_name").isNotNull() & F.col(cluster).isNotNull()).groupBy("scan_name")
    counts = rows.agg(*(F.count_if(F.col(cluster) == v).alias(f"{prefix}{v}") for v in values), F.count("*").alias("n_cells"))
    return counts.select("scan_name", *((F.col(f"{prefix}{v}") / F.col("n_cells")).alias(f"{prefix}{v}") for v in values), "n_cells")


def composition_long(df: DataFrame, cluster: str) -> DataFrame:
    """(scan_name, cluster, p, n_cells) for clusters that occur; for any number of clusters."""
    counts = df.where(F.col("scan_name").isNotNull() & F.col(cluster).isNotNull()).groupBy("scan_name", cluster).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("scan_name"))
    return counts.select("scan_name", F.col(cluster).alias("cluster"), (F.col("n") / total).alias("p"), total.alias("n_cells"))


def contingency(df: DataFrame, a: str, b: str, values: Sequence) -> DataFrame:
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return rows.groupBy(a).agg(*(F.count_if(F.col(b) == v).alias(f"{b}_{v}") for v in values))


def crosstab_norm(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, share): each row of the cross table sums to 1."""
    counts = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    return counts.select(a, b, (F.col("n") / F.sum("n").over(Window.partitionBy(a))).alias("share"))


def nmi(df: DataFrame, methods: Sequence[str], label: str) -> DataFrame:
    """(method, nmi, n_overlap, n_clusters, n_labels): arithmetic-mean normalised mutual information, best first."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).cast("string").alias("c")) for m in methods)))
    rows = df.where(F.col(label).isNotNull()).select(pairs.alias("p"), F.col(label).alias("l")).select("p.method", "p.c", "l").where("c is not null")
    joint = rows.groupBy("method", "c", "l").agg(F.count("*").alias("n"))
    by = lambda *k: F.sum("n").over(Window.partitionBy("method", *k))
    j = joint.withColumns({"total": by(), "nc": by("c"), "nl": by("l")})
    p, pc, pl = F.col("n") / F.col("total"), F.col("nc") / F.col("total"), F.col("nl") / F.col("total")
    terms = j.groupBy("method").agg(
        F.sum(p * F.log(p / (pc * pl))).alias("mi"), F.sum(-p * F.log(pc)).alias("hc"), F.sum(-p * F.log(pl)).alias("hl"), F.sum("n").alias("n_overlap"), F.count_distinct("c").alias("n_clusters"), F.count_distinct("l").alias("n_labels")
    )
    value = F.when(F.col("hc") + F.col("hl") > 0, 2 * F.col("mi") / (F.col("hc") + F.col("hl"))).otherwise(1.0)
    return terms.select("method", value.alias("nmi"), "n_overlap", "n_clusters", "n_labels").orderBy(F.desc_nulls_last("nmi"), "method")


def fold_summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation over folds."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def split_summary(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean and sample deviation over splits, 0 for a single one."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count("*").alias("n_splits"))


def region_summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, deviation and count per region over the rows in which the region exists."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, "region").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("n"))


def fold_region_summary(df: DataFrame, value: str, n_folds: int, always: Sequence[str] = ("overall",)) -> DataFrame:
    """Mean and deviation of fold means; regions other than `always` only if every fold has them."""
    folds = df.where(F.col(value).isNotNull()).groupBy("variant", "region", "fold").agg(F.avg(value).alias("m"))
    out = folds.groupBy("variant", "region").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.count("*").alias("n_folds"))
    return out.where((F.col("n_folds") == n_folds) | F.col("region").isin(*always))


def compare_variants(df: DataFrame, value: str, baseline: str) -> DataFrame:
    """Mean per variant and region, and its difference from the baseline's."""
    means = df.groupBy("variant", "region").agg(F.avg(value).alias("mean"))
    base = F.max(F.when(F.col("variant") == baseline, F.col("mean"))).over(Window.partitionBy("region"))
    return means.withColumn("difference", F.col("mean") - base)


def feature_summary(df: DataFrame) -> DataFrame:
    """Of rows (feature, error, performance, weight, contribution): means, the weight's share, the total score."""
    out = df.groupBy("feature").agg(*(F.avg(c).alias(c) for c in ("error", "performance", "weight", "contribution")))
    whole = Window.partitionBy(F.lit(0))  # a row per feature
    out = out.withColumns({"weight_share": F.col("weight") / F.sum("weight").over(whole), "total_score": F.sum("contribution").over(whole) / F.sum("weight").over(whole)})
    return out.orderBy(F.desc("weight"), "feature")


def image_labels(labels: DataFrame) -> DataFrame:
    """(image_name, label, ambiguous): an image's class names, distinct, in order, joined by '|'."""
    names = labels.where("class_name is not null").groupBy("image_name").agg(F.sort_array(F.collect_set("class_name")).alias("names"))
    return names.select("image_name", F.array_join("names", "|").alias("label"), (F.size("names") > 1).alias("ambiguous"))


def box_summary(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quartiles and whiskers (the extremes within 1.5 interquartile ranges) of each group."""
    rows = df.join(quantiles(df, value, [0.25, 0.5, 0.75], by), list(by))
    spread = 1.5 * (F.col("q")[2] - F.col("q")[0])
    inside = F.col(value).between(F.col("q")[0] - spread, F.col("q")[2] + spread)
    groups = rows.groupBy(*by, "q").agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.count(value).alias("n"))
    return groups.select(*by, "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high", "n")


def centroids(df: DataFrame, cluster: str, cols: Sequence[str]) -> DataFrame:
    return df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(*(F.avg(c).alias(c) for c in cols))


def duplicates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1")


def cleaning_stats(counts: DataFrame) -> DataFrame:
    """Of (mask key, n_components): masks in all, with one, several and no components, components removed."""
    c = F.col("n_components")
    return counts.agg(F.count("*").alias("total"), F.count_if(c == 1).alias("single"), F.count_if(c > 1).alias("multi"), F.count_if(c == 0).alias("empty"), F.coalesce(F.sum(F.when(c > 1, c - 1)), F.lit(0)).alias("removed"))


def counts(df: DataFrame, image: Sequence[str] = ("scan_name", "image_name")) -> DataFrame:
    """Boxes, images, and boxes per image, in two aggregations."""
    per = df.groupBy(*image).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n_boxes"), F.count("*").alias("n_images"), F.avg("n").alias("mean_per_image"), F.max("n").alias("max_per_image"))


def loocv_summary(df: DataFrame, value: str, by: Sequence[str], threshold: float, baseline: DataFrame | None = None) -> DataFrame:
    """Mean, deviation, extremes, share above a threshold and runs of each group; shift from a baseline (by, base)."""
    v = F.col(value)
    out = df.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg((v > threshold).cast("double")).alias("share_above"), F.count_distinct("run").alias("n_runs"))
    if baseline is None:
        return out
    return out.join(baseline, [c for c in by if c in baseline.columns], "left").withColumn("shift", F.col("mean") - F.col("base"))


def testset_scores(df: DataFrame, metrics: Sequence[str] = ("dice", "iou", "morphology")) -> DataFrame:
    return df.groupBy("variant").agg(*(F.avg(m).alias(m) for m in metrics), F.count("*").alias("n_cells"))


def morphology_score(pred: DataFrame, target: DataFrame, weights: DataFrame, features: Sequence[str], key: Sequence[str], eps: float = 1e-8) -> DataFrame:
    """(key, feature, error, performance, weight, contribution, score): symmetric relative errors, weighted.

    Features without a weight weigh 0; a cell whose weights sum to 0 scores 0. Weights are a row per feature."""
    wide = lambda df, name: df.select(*key, *(F.col(f).cast("double").alias(f"_{name}{k}") for k, f in enumerate(features)))
    each = F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"_p{k}").alias("p"), F.col(f"_t{k}").alias("t")) for k, f in enumerate(features))))
    # Cells meet whole, in one row each; their features part after that, where they are.
    rows = wide(pred, "p").join(wide(target, "t"), list(key)).select(*key, each).join(F.broadcast(weights), "feature", "left")
    p, t = F.col("p"), F.col("t")
    error = F.abs(p - t) / (F.abs(p) + F.abs(t) + eps)
    rows = rows.select(*key, "feature", error.alias("error"), (1 - error).alias("performance"), F.coalesce("weight", F.lit(0.0)).alias("weight")).withColumn("contribution", F.col("weight") * F.col("performance"))
    cell = Window.partitionBy(*key)
    total = F.sum("weight").over(cell)
    return rows.withColumn("score", F.when(total > 0, F.sum("contribution").over(cell) / total).otherwise(0.0))
