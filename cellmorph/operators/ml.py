"""Clustering, embeddings and diverse selection (M1-M11). Keys travel with every row."""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import discard, shared_dir, stored
from .joins import pairwise_distance
from .kmeans import _squares, fit, labelled
from .sampling import draw
from .stats import zscore

#: Rows of a block of vectors, each of which meets every other.
BLOCK = 1024


def assembled(df: DataFrame, cols: Sequence[str], scale: bool = True) -> DataFrame:
    """df's complete rows with `features`, z-scored by the population deviation."""
    rows = df.dropna(subset=list(cols))
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(zscore(rows, cols) if scale else rows)


def vectors(df: DataFrame, vector: str) -> DataFrame:
    """df's rows that have a vector, with `features`: the array as it is."""
    return df.where(F.col(vector).isNotNull()).withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def pca(df: DataFrame, cols: Sequence[str], k: int = 2) -> tuple[DataFrame, list[float]]:
    """(rows with pc array, explained variance shares) of z-scored columns."""
    return pca_of(assembled(df, cols), k)


def pca_of(rows: DataFrame, k: int = 2) -> tuple[DataFrame, list[float]]:
    """The same of rows with `features`."""
    model = PCA(k=k, inputCol="features", outputCol="_pc").fit(rows)
    return model.transform(rows).withColumn("pc", vector_to_array("_pc")).drop("features", "_pc"), model.explainedVariance.toArray().tolist()


def kmeans(rows: DataFrame, k: int = 4, seed: int = 0, n_init: int = 50) -> tuple[DataFrame, float]:
    """(rows with `cluster`, cost) of the best of several starts, which are moved together; rows have `features`."""
    centres, cost = fit(rows, [k], n_init, seed)[k]
    return labelled(rows, centres), cost


def best_k(rows: DataFrame, key: str, ks: Sequence[int] = (2, 3, 4), seed: int = 0, n_init: int = 50) -> DataFrame:
    """(k, silhouette), best first; all k are fitted in the same passes, the silhouettes are those of all rows, whatever their `key`."""
    marked = rows
    for k, (centres, _) in fit(rows, ks, n_init, seed).items():
        marked = labelled(marked, centres, f"_k{k}")
    found = [(k, s) for k, (s, _) in whole_silhouettes(marked, "features", [f"_k{k}" for k in ks], ks).items()]
    return rows.sparkSession.createDataFrame(found, "k int, silhouette double").orderBy(F.desc_nulls_last("silhouette"), "k")


def _vector_blocks(n_labels: int):
    """Rows (v, labels) as blocks: the vectors of BLOCK rows at most in one value, and their labels in another."""

    def task(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                v = part.column(0).flatten().to_numpy(zero_copy_only=False).astype("<f8")
                marks = np.stack([part.column(1 + j).to_numpy() for j in range(n_labels)], 1).astype("<i4")
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), pa.array([v.tobytes()], pa.binary()), pa.array([marks.tobytes()], pa.binary())], ["n", "v", "marks"])

    return task


def _distance_sums(ks: Sequence[int]):
    """Pairs of blocks, those of one `a` together, to the distances of a's rows summed over each cluster of each k."""
    width, first = sum(ks), np.cumsum([0, *ks])[:-1]

    def task(batches):
        now, rows, sums, marks = None, None, None, None
        for batch in batches:
            for a, n, v, of, b, m, w, on in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a != now:
                    if now is not None:
                        yield _emitted(now, marks, sums)
                    now, rows, sums, marks = a, np.frombuffer(v).reshape(n, -1), np.zeros((n, width)), of
                d = np.sqrt(_squares(rows, np.frombuffer(w).reshape(m, -1)))
                if a == b:
                    np.fill_diagonal(d, 0)  # a row is no neighbour of its own
                member = np.zeros((m, width))
                member[np.arange(m)[:, None], np.frombuffer(on, "<i4").reshape(m, -1) + first] = 1
                sums += d @ member
        if now is not None:
            yield _emitted(now, marks, sums)

    return task


def _emitted(block: int, marks: bytes, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([marks], pa.binary()), pa.array([sums.tobytes()], pa.binary())], ["a", "marks", "sums"])


def _row_values(ks: Sequence[int], sizes: np.ndarray):
    """Sums of a block's rows to (k, total of their silhouettes, how many have one)."""
    ends = np.cumsum([0, *ks])

    def task(batches):
        for batch in batches:
            for marks, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                of, out = np.frombuffer(marks, "<i4").reshape(-1, len(ks)), []
                sums = sum(np.frombuffer(p).reshape(len(of), -1) for p in parts)
                for j, k in enumerate(ks):
                    s, n, own = sums[:, ends[j] : ends[j + 1]], sizes[ends[j] : ends[j + 1]], of[:, j]
                    at = np.arange(len(own))
                    means = np.where(n > 0, s / np.maximum(n, 1), np.inf)
                    means[at, own] = np.inf
                    other, alone = means.min(1), n[own] == 1
                    inner = s[at, own] / np.maximum(n[own] - 1, 1)
                    most = np.maximum(inner, other)
                    known = np.isfinite(other)
                    value = np.where(alone | (most == 0) | ~known, 0.0, (np.where(known, other, 0) - inner) / np.where((most == 0) | ~known, 1, most))
                    out.append((int(k), float(value[known].sum()), int(known.sum())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.float64(), pa.int64()), strict=True)], ["k", "s", "n"])

    return task


def whole_silhouettes(marked: DataFrame, features: str, labels: Sequence[str], ks: Sequence[int]) -> dict[int, tuple[float | None, int]]:
    """{k: (mean silhouette, rows that have one)}, Euclidean, over all rows; a column of labels (0 to k - 1) for each k.

    Rows that are alone in a cluster have 0, rows without another cluster none. Each row meets every other, so work grows with the
    square of the rows: blocks of them meet in a Cartesian product, whose sides Spark reads again for each pair of parts (no
    shuffle), and a task holds two blocks and the sums of one. Only numbers per cluster reach the driver."""
    spark = marked.sparkSession
    vectors_ = marked.select(vector_to_array(features).alias("v"), *labels)
    blocks = stored(vectors_.mapInArrow(_vector_blocks(len(ks)), "n int, v binary, marks binary").withColumn("a", F.monotonically_increasing_id()), "blocks")
    counted = vectors_.select(F.posexplode(F.array(*labels)).alias("j", "label")).groupBy("j", "label").agg(F.count("*").alias("n")).collect()
    sizes, first = np.zeros(sum(ks)), np.cumsum([0, *ks])
    for j, label, n in counted:
        sizes[first[j] + label] = n
    parts = int(max(1, min(spark.sparkContext.defaultParallelism, sizes.sum() / max(len(ks), 1) // BLOCK)))
    left, right = blocks.select("a", "n", "v", "marks").repartition(parts), blocks.select(F.col("a").alias("b"), F.col("n").alias("m"), F.col("v").alias("w"), F.col("marks").alias("on")).repartition(parts)
    pairs = left.hint("shuffle_replicate_nl").crossJoin(right)
    sums = pairs.mapInArrow(_distance_sums(ks), "a long, marks binary, sums binary").groupBy("a").agg(F.first("marks").alias("marks"), F.collect_list("sums").alias("sums"))  # a value for each part of the other side
    found = sums.select("marks", "sums").mapInArrow(_row_values(ks, sizes), "k int, s double, n long").groupBy("k").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    discard(blocks)
    of = {r["k"]: (r["s"] / r["n"] if r["n"] else None, r["n"]) for r in found}
    return {k: of.get(k, (None, 0)) for k in ks}


def silhouette(df: DataFrame, key: str, vector: str, label: str, limit: int = 1000) -> DataFrame:
    """One row (silhouette, n): Euclidean, over a sample of up to `limit` rows by a hash of key."""
    few = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).orderBy(draw([key], 0), key).limit(limit)
    labels = few.select(F.col(key).alias("a"), F.col(label).alias("la"))
    pairs = pairwise_distance(few, key, vector, limit).join(labels, "a").join(labels.select(F.col("a").alias("b"), F.col("la").alias("lb")), "b")
    means = pairs.groupBy("a", "la", "lb").agg(F.avg("distance").alias("d"))
    own, other = F.max(F.when(F.col("la") == F.col("lb"), F.col("d"))), F.min(F.when(F.col("la") != F.col("lb"), F.col("d")))
    s = means.groupBy("a").agg(own.alias("i"), other.alias("o"))
    value = F.when(F.col("i").isNull(), 0.0).when(F.greatest("i", "o") == 0, 0.0).otherwise((F.col("o") - F.col("i")) / F.greatest("i", "o"))
    return s.where("o is not null").agg(F.avg(value).alias("silhouette"), F.count("*").alias("n"))


def gmm(rows: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """rows with `membership`, an array of k probabilities that sum to 1."""
    model = GaussianMixture(k=k, seed=seed, featuresCol="features", probabilityCol="_p", predictionCol="cluster").fit(rows)
    return model.transform(rows).withColumn("membership", vector_to_array("_p")).drop("_p")


def _square(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def _members(v: np.ndarray, centres: np.ndarray, m: float) -> np.ndarray:
    """(rows, centres): memberships of the rows of v."""
    inverse = (1.0 / np.maximum(((v[:, None] - centres) ** 2).sum(2), 1e-12)) ** (1.0 / (m - 1))
    return inverse / inverse.sum(1, keepdims=True)


def _weighted_sums(centres: np.ndarray, last: np.ndarray | None, m: float):
    """A task's sums: x of (centre i, dimension j), of the weights (j -1), and (i -1) the largest change from `last`."""

    def task(batches):
        weight, sums, change = np.zeros(len(centres)), np.zeros_like(centres), 0.0
        for batch in batches:
            if batch.num_rows:
                v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for part in np.array_split(v, -(-len(v) // 2048)):
                    u = _members(part, centres, m)
                    if last is not None:
                        change = max(change, float(np.abs(u - _members(part, last, m)).max()))
                    weight += (u**m).sum(0)
                    sums += (u**m).T @ part
        rows = [(-1, -1, change)] + [(i, -1, float(w)) for i, w in enumerate(weight)] + [(i, j, float(x)) for i, line in enumerate(sums) for j, x in enumerate(line)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.float64()), strict=True)], ["i", "j", "x"])

    return task


def fuzzy_cmeans(df: DataFrame, key: str, vector: str, k: int, m: float = 2.0, tol: float = 0.005, rounds: int = 1000, seed: int = 0) -> DataFrame:
    """(key, membership): k centres are moved to weighted means until memberships change by less than tol.

    Only the centres (k vectors) pass through the driver; each round is one aggregation over the rows, whose vectors have
    one length."""
    rows = df.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v")).persist()
    try:
        first = rows.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))).limit(k).collect()
        if not first:
            return rows.select(key, F.col("v").alias("membership"))
        centres, last = np.array([r["v"] for r in first]), None
        for _ in range(rounds):
            sums = rows.select("v").mapInArrow(_weighted_sums(centres, last, m), "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("s"), F.max("x").alias("most")).collect()
            if last is not None and max(r["most"] for r in sums if r["i"] < 0) < tol:
                break
            last, centres = centres, np.zeros_like(centres)
            weight = {r["i"]: r["s"] for r in sums if r["j"] < 0 <= r["i"]}
            for r in sums:
                if r["j"] >= 0:
                    centres[r["i"], r["j"]] = r["s"] / weight[r["i"]]
        d = [F.greatest(_square("v", F.array(*map(F.lit, x))), F.lit(1e-12)) for x in centres.tolist()]
        inverse = [F.pow(1.0 / x, 1.0 / (m - 1)) for x in d]
        return rows.select(key, F.array(*inverse).alias("u")).select(key, F.transform("u", lambda x: x / F.aggregate("u", F.lit(0.0), lambda t, y: t + y)).alias("membership"))
    finally:
        rows.unpersist()


def soft_metrics(df: DataFrame, membership: str = "membership", threshold: float = 0.8) -> DataFrame:
    """(k, mean_entropy, max_entropy, pct_confident) of membership arrays; entropy in bits."""
    bits = -F.aggregate(membership, F.lit(0.0), lambda s, p: s + F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return df.agg(F.max(F.size(membership)).alias("k"), F.avg(bits).alias("mean_entropy"), F.log2(F.max(F.size(membership)).cast("double")).alias("max_entropy"), (F.avg((F.array_max(membership) > threshold).cast("double")) * 100).alias("pct_confident"))


def continuity(high: DataFrame, low: DataFrame, key: str, vector: str, k: int = 10, limit: int = 500) -> DataFrame:
    """One row (value, n): how far neighbours in `high` stay near in `low`; 1 is best. Over a sample, by a hash of key, of the keys that have both vectors."""
    has = lambda df: df.where(F.col(vector).isNotNull())
    keys = has(high).select(key).join(has(low).select(key), key, "left_semi")
    high, low = high.join(keys, key, "left_semi"), low.join(keys, key, "left_semi")

    def ranks(df, name):
        w = Window.partitionBy("a").orderBy("distance", "b")
        return pairwise_distance(df, key, vector, limit).withColumn(name, F.row_number().over(w)).drop("distance")

    near = ranks(high, "h").where(F.col("h") <= k)
    late = near.join(ranks(low, "l"), ["a", "b"])
    n = keys.limit(limit).agg(F.count("*").alias("n"))
    penalty = late.agg(F.coalesce(F.sum(F.greatest(F.col("l") - k, F.lit(0))), F.lit(0)).alias("penalty"))
    return penalty.crossJoin(n).select((1 - F.col("penalty") / (k * F.col("n") * (2 * F.col("n") - 3 * k - 1) / 2.0)).alias("value"), "n")


def trustworthiness(high: DataFrame, low: DataFrame, key: str, vector: str, k: int = 10, limit: int = 500) -> DataFrame:
    """continuity with the roles exchanged."""
    return continuity(low, high, key, vector, k, limit)


def embedding_f1(high: DataFrame, low: DataFrame, key: str, vector: str, k: int = 10, limit: int = 500) -> DataFrame:
    """(continuity, trustworthiness, f1)."""
    c = continuity(high, low, key, vector, k, limit).select(F.col("value").alias("continuity"))
    t = trustworthiness(high, low, key, vector, k, limit).select(F.col("value").alias("trustworthiness"))
    return c.crossJoin(t).withColumn("f1", 2 * F.col("continuity") * F.col("trustworthiness") / (F.col("continuity") + F.col("trustworthiness")))


def _farthest(pool: DataFrame, key: str, n: int, every: int = 10) -> DataFrame:
    """pool (key, v, d) to its n farthest points in turn: (key, rank, score).

    A pick is one aggregation (no sort); the distances are one column, whose lineage is cut at checkpoints."""
    spark, picks = pool.sparkSession, []
    for i in range(n):
        best = pool.agg(F.max_by(F.struct(key, "v", "d"), F.struct("d", -F.col(key))).alias("b")).first()["b"]
        if best is None or best["d"] is None or best["d"] < 0:
            break
        picks.append((best[key], i + 1, float(best["d"])))
        there = F.sqrt(_square("v", F.array(*map(F.lit, best["v"]))))
        pool = pool.withColumn("d", F.when(F.col(key) == best[key], -1.0).otherwise(F.least("d", there)))
        if (i + 1) % every == 0:
            pool = pool.checkpoint()
    return spark.createDataFrame(picks, f"{key} {dict(pool.dtypes)[key]}, rank int, score double")


def _checkpointing(df: DataFrame) -> None:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))


def diverse_select(df: DataFrame, key: str, vector: str, n: int) -> DataFrame:
    """n rows: the one farthest from the centroid, then always the one farthest from all chosen."""
    _checkpointing(df)
    rows = df.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"))
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    centre = rows.agg(*(F.avg(F.col("v")[j]).alias(f"c{j}") for j in range(dims))).first() if dims else []
    start = F.sqrt(_square("v", F.array(*map(F.lit, centre)))) if dims else F.lit(0.0)
    first = rows.withColumn("d", start).agg(F.max_by(F.struct(key, "v", "d"), F.struct("d", -F.col(key))).alias("b")).first()["b"]
    if first is None:
        return df.sparkSession.createDataFrame([], f"{key} {dict(rows.dtypes)[key]}, rank int, score double")
    pool = rows.withColumn("d", F.when(F.col(key) == first[key], -1.0).otherwise(F.sqrt(_square("v", F.array(*map(F.lit, first["v"]))))))
    rest = _farthest(pool.checkpoint(), key, n - 1).withColumn("rank", F.col("rank") + 1)
    return df.sparkSession.createDataFrame([(first[key], 1, float(first["d"]))], rest.schema).union(rest)


#: Known vectors of a block, blocks that meet the pool in one pass, and rows of both whose differences are held at once.
KNOWN_BLOCK, STORE_EVERY, ROWS, KNOWN_ROWS = 4096, 16, 64, 128


def _least_distances(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Each row's distance from the nearest row of w; a few megabytes at once, whatever the number of rows."""
    out = np.full(len(x), np.inf)
    for i in range(0, len(x), ROWS):
        for j in range(0, len(w), KNOWN_ROWS):
            gap = x[i : i + ROWS, None] - w[j : j + KNOWN_ROWS]
            gap *= gap
            np.minimum(out[i : i + ROWS], gap.sum(2).min(1), out=out[i : i + ROWS])
    return np.sqrt(out)


def active_select(pool: DataFrame, known: DataFrame, key: str, vector: str, n: int) -> DataFrame:
    """n rows of the pool, each the farthest from the known rows and from those chosen before.

    Known rows come in blocks of some thousand vectors, however many there are; one Python task walks the blocks of a pass, and
    the pool is stored between passes, so that no chain of Python tasks runs at once."""
    _checkpointing(pool)
    kind = dict(pool.dtypes)[key]
    near = pool.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"), F.lit(float("inf")).alias("d"))
    old = known.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("w"))
    blocks = old.count() // KNOWN_BLOCK + 1
    old = stored(old.withColumn("block", F.pmod(F.xxhash64("w"), F.lit(blocks))).distinct(), "known") if blocks > 1 else old.withColumn("block", F.lit(0))
    for b in range(0, blocks, STORE_EVERY):
        found = old.where(F.col("block").between(b, b + STORE_EVERY - 1)).select("w").toArrow().column("w").combine_chunks()
        if not len(found):
            continue
        w = found.flatten().to_numpy(zero_copy_only=False).reshape(len(found), -1)

        def closer(batches, w=w):
            for batch in batches:
                v, d = batch.column("v"), batch.column("d").to_numpy()
                least = _least_distances(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1), w) if len(v) else d
                yield pa.RecordBatch.from_arrays([batch.column(key), v, pa.array(np.minimum(d, least))], [key, "v", "d"])

        near = near.mapInArrow(closer, f"`{key}` {kind}, v array<double>, d double")
        if b + STORE_EVERY < blocks:
            near = stored(near, "near")
    return _farthest(near.where("d < double('infinity')").checkpoint(), key, n)
