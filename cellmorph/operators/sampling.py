"""Samples and splits in the order of a hash (R1-R10): the same rows on any cluster and in any input order.

A hash of key and seed stands for the random draw. Splits need a rank over all keys; keys are images or
cells of a labelled set. `rank_by_hash` counts ranks in two steps (rows per hash prefix, then within each
prefix), so that no task holds all keys.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored


def draw(keys: Sequence[str], seed) -> Column:
    return F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string")))


def rank_by_hash(df: DataFrame, keys: Sequence[str], seed, part: Sequence[str] = ()) -> DataFrame:
    """df with `rank` (from 0 in hash order) and `n` (rows), within each part."""
    rows = df.withColumn("_h", draw(keys, seed)).withColumn("_p", F.substring("_h", 1, 3)).withColumn("_h", F.unhex("_h"))  # bytes sort as their digits
    sizes = rows.groupBy(*part, "_p").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))  # 4096 prefixes
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_c").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("_c").over(whole)})
    inner = Window.partitionBy(*part, "_p").orderBy("_h", *keys)
    return rows.join(F.broadcast(sizes.drop("_c")), [*part, "_p"]).withColumn("rank", F.col("_before") + F.row_number().over(inner) - 1).drop("_h", "_p", "_before")


def reached(df: DataFrame, keys: Sequence[str], seed, ends: Sequence, part: Sequence[str] = ()) -> DataFrame:
    """df with `reached`: how many of the growing counts `ends` (columns of n, the part's rows) a row's rank in hash order has reached.

    A hash prefix that holds no end decides for its rows by itself, so they are not moved; only rows of the few prefixes in
    which an end falls are ranked. A row per part and prefix is broadcast."""
    rows = df.withColumn("_h", draw(keys, seed)).withColumn("_p", F.substring("_h", 1, 3))
    whole = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))  # 4096 prefixes
    before = F.coalesce(F.sum("_c").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy(*part, "_p").agg(F.count("*").alias("_c")).withColumns({"_before": before, "n": F.sum("_c").over(whole)}).withColumn("_ends", F.array(*(e.cast("double") for e in ends)))
    passed = lambda rank: F.size(F.filter("_ends", lambda e: e <= rank))
    sizes = sizes.select(*part, "_p", "_before", "_ends", passed(F.col("_before")).alias("_low"), passed(F.col("_before") + F.col("_c") - 1).alias("_high"))
    sure = rows.join(F.broadcast(sizes.where("_low = _high").select(*part, "_p", F.col("_low").alias("reached"))), [*part, "_p"])
    near = rows.join(F.broadcast(sizes.where("_low < _high")), [*part, "_p"])
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(*part, "_p").orderBy("_h", *keys)) - 1
    ranked = near.withColumn("_rank", rank).withColumn("reached", passed(F.col("_rank")))
    return sure.select(*df.columns, "reached").unionByName(ranked.select(*df.columns, "reached"))


def _named(df: DataFrame, *names: str) -> DataFrame:
    """`split` by the number of ends reached."""
    return df.withColumn("split", F.element_at(F.array(*map(F.lit, names)), F.col("reached") + 1)).drop("reached")


def sample_k(df: DataFrame, k: int, keys: Sequence[str], seed=0) -> DataFrame:
    """k rows, all if there are fewer, in key order."""
    return df.withColumn("_h", draw(keys, seed)).orderBy("_h", *keys).limit(k).drop("_h").orderBy(*keys)


def _sizes(ratios: Sequence[float]):
    if abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("ratios must sum to 1")
    first = F.floor(F.col("n") * F.lit(ratios[0]))
    return first, F.floor(F.col("n") * F.lit(ratios[1]))


def split3(df: DataFrame, keys: Sequence[str], ratios=(0.7, 0.1, 0.2), seed=0) -> DataFrame:
    """`split` train, val or test: whole sizes rounded down, the rest to test."""
    train, val = _sizes(ratios)
    return _named(reached(df, keys, seed, [train, train + val]), "train", "val", "test")


def split_70_15_15(df: DataFrame, keys: Sequence[str], seed=0) -> DataFrame:
    """Two stages: 30 % (rounded up) set aside, half of it (rounded up) as test."""
    aside = F.ceil(F.col("n") * F.lit(0.3))
    test = F.ceil(aside * F.lit(0.5))
    return _named(reached(df, keys, seed, [test, aside]), "test", "val", "train")


def kfold(df: DataFrame, keys: Sequence[str], k: int = 5, val_share: float = 0.1, seed=0) -> DataFrame:
    """(…, fold, split) for each row and fold: each row is test once; of the rest a share is validation."""
    ranked = stored(rank_by_hash(df, keys, seed).withColumn("own", F.pmod("rank", F.lit(k))).drop("rank", "n"), "folds")
    each = ranked.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    rest = _named(reached(each.where("own <> fold").drop("own"), [*keys, "fold"], seed, [F.ceil(F.col("n") * F.lit(val_share))], ["fold"]), "val", "train")
    return rest.unionByName(each.where("own = fold").drop("own").withColumn("split", F.lit("test")))


def repeated_splits(df: DataFrame, keys: Sequence[str], k: int = 5, ratios=(0.7, 0.1, 0.2), seed=0) -> DataFrame:
    """k independent splits: test sets may overlap."""
    train, val = _sizes(ratios)
    each = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    return _named(reached(each, [*keys, "fold"], seed, [train, train + val], ["fold"]), "train", "val", "test")


def split2(df: DataFrame, keys: Sequence[str], share: float = 0.8, seed=0) -> DataFrame:
    return _named(reached(df, keys, seed, [F.floor(F.col("n") * F.lit(share))]), "train", "val")


def labelled_fraction(train: DataFrame, keys: Sequence[str], share: float, seed=0) -> DataFrame:
    """max(1, round(n * share)) rows keep their label."""
    few = reached(train, keys, seed, [F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(share)))])
    return few.withColumn("labelled", F.col("reached") == 0).drop("reached")


def learning_curve_plan(train: DataFrame, keys: Sequence[str], portions=tuple(range(1, 11)), seeds=5) -> DataFrame:
    """(keys, portion, split_seed) of every run: portions are tenths; the full one has a single seed.

    All portions of a seed follow one order, so a row is placed once a seed: it is in every portion whose end it has not reached."""
    portions = sorted(portions)
    each = train.select(*keys, F.explode(F.array(*map(F.lit, range(seeds)))).alias("split_seed"))
    placed = reached(each, [*keys, "split_seed"], 0, [F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(p / 10))) for p in portions], ["split_seed"])
    runs = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(p / 10).alias("portion"), F.lit(1 if p == 10 else seeds).alias("seeds")) for i, p in enumerate(portions)))
    mine = F.filter(runs, lambda r: (r["i"] >= F.col("reached")) & (F.col("split_seed") < r["seeds"]))
    return placed.select(*keys, F.explode(mine["portion"]).alias("portion"), "split_seed")


def random_review(det: DataFrame, n: int, image: Sequence[str], threshold: float = 0.5, seed=0) -> DataFrame:
    """The first n images in hash order that have a box above the threshold."""
    seen = det.where(F.col("conf") > threshold).select(*image).distinct()
    return seen.withColumn("_h", draw(image, seed)).orderBy("_h", *image).limit(n).drop("_h")


def inspect_sample(df: DataFrame, n: int, image: Sequence[str], seed=0) -> DataFrame:
    """n images and how many boxes each has."""
    chosen = sample_k(df.select(*image).distinct(), n, image, seed)
    return df.join(chosen, list(image), "left_semi").groupBy(*image).agg(F.count("*").alias("n_boxes"))
