"""Exact inner-product top-k with KD-trees per shard.

Components become integers floor(256 x). Rows are dealt to shards by a hash of vec_id, so that shards are
even whatever the vectors are. Each shard's tree splits at medians of the widest dimension and keeps tight
boxes. A query walks a tree best box first, as long as a box can beat its k-th score: the bound of a box is
the sum over dimensions of the larger of q*low and q*high. Queries first walk one shard each (their own);
the k-th scores found there travel with them to all other shards.

A task streams its shards: the shard's points, then its queries in batches, so it holds one shard's tree and
one batch. Every query meets every shard, in blocks; the answer is exact.

Defined results: vectors that are null or hold a null or non-finite component take no part; shorter vectors
count as padded by zeros; equal scores go to the smaller vec_id; rows that repeat a vec_id are separate
candidates (each other's query never finds its own id); an empty table gives no rows. Scores are 64-bit.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

TOP, EVERY = 5, 50
#: Points of a shard, and the number of shards at most; beyond, shards grow.
SHARD, SHARDS = 8192, 4096
LEAF = 64


def quantised(table: DataFrame) -> DataFrame:
    """(vec_id, v array<long>): floor(256 * x) of the rows that take part."""
    x = F.col("embedding")
    whole = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return table.where(whole & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(256 * e.cast("double"))).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded by zeros to the width."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if len(ends) and (ends == width).all():
        return flat.reshape(len(ends), width)
    out, at = np.zeros((len(ends), width), np.int64), 0
    for i, n in enumerate(ends):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


class Tree:
    """A KD-tree over integer points: nodes with boxes, leaves of up to LEAF points."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.arange(len(ids))
        self.low, self.high, self.kids, self.span = [], [], [], []
        largest = int(np.abs(points).max(initial=0))
        # Sums of products stay whole in float64 up to 2**53; beyond, 64-bit integers are multiplied.
        self.kind = np.float64 if points.shape[1] * max(1, largest) ** 2 < 1 << 53 else np.int64
        self._build(points, order, 0, len(ids))
        self.ids, self.points = ids[order], points[order].astype(self.kind)
        self.low, self.high = np.array(self.low).astype(self.kind), np.array(self.high).astype(self.kind)

    def _build(self, points, order, a, b) -> int:
        own = points[order[a:b]]
        low, high = own.min(0), own.max(0)
        node = len(self.kids)
        self.low.append(low)
        self.high.append(high)
        self.kids.append(None)
        self.span.append((a, b))
        if b - a > LEAF and (high > low).any():
            dim, half = int((high - low).argmax()), (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, dim], half)]
            self.kids[node] = self._build(points, order, a, a + half), self._build(points, order, a + half, b)
        return node

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """Per query up to k (score, vec_id) that reach its floor, best first; never its own id."""
        if self.kind is np.float64 and queries.shape[1] * max(1, int(np.abs(queries).max(initial=0))) * max(1, float(np.abs(self.points).max(initial=0))) >= 1 << 53:
            self.kind, self.points, self.low, self.high = np.int64, self.points.astype(np.int64), self.low.astype(np.int64), self.high.astype(np.int64)
        q = queries.astype(self.kind)
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        bounds = plus @ self.high.T + minus @ self.low.T  # of every box for every query: boxes are few
        out = []
        for i in range(len(q)):
            best: list[tuple[int, int]] = []
            floor = floors[i]
            heap = [(-bounds[i, 0], 0)]
            while heap and -heap[0][0] >= floor:
                _, node = heapq.heappop(heap)
                if kids := self.kids[node]:
                    for kid in kids:
                        if bounds[i, kid] >= floor:
                            heapq.heappush(heap, (-bounds[i, kid], kid))
                    continue
                a, b = self.span[node]
                scores = self.points[a:b] @ q[i]
                at = np.flatnonzero((scores >= floor) & (self.ids[a:b] != query_ids[i]))
                if not len(at):
                    continue
                if len(at) > k:  # equal vectors make large leaves: the smallest ids of the best scores
                    at = at[np.lexsort((self.ids[a:b][at], -scores[at]))[:k]]
                best = sorted([*best, *zip((-scores[at]).tolist(), self.ids[a:b][at].tolist(), strict=True)])[:k]
                if len(best) == k:
                    floor = max(floor, -best[-1][0])
            out.append([(int(-s), j) for s, j in best])
        return out


def _search(width: int, k: int):
    def task(batches):
        shard, tree, ids, rows = None, None, [], []
        for batch in batches:
            keys = batch.column("shard").to_numpy(zero_copy_only=False)
            flags = batch.column("is_query").to_numpy(zero_copy_only=False).astype(np.int8)
            cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(flags) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if a == b:
                    continue
                if keys[a] != shard:
                    shard, tree, ids, rows = keys[a], None, [], []
                part = batch.slice(a, b - a)
                matrix, own = _matrix(part.column("v"), width), part.column("vec_id").to_numpy()
                if not flags[a]:
                    ids.append(own)
                    rows.append(matrix)
                    continue
                if tree is None:
                    if not ids:
                        continue
                    tree = Tree(np.concatenate(ids), np.concatenate(rows))
                    ids, rows = [], []
                found = tree.search(own, matrix, part.column("floor").to_numpy(zero_copy_only=False), k)
                flat = [(q, row, v, s) for q, row, best in zip(own.tolist(), part.column("row").to_pylist(), found, strict=True) for s, v in best]
                if flat:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*flat, strict=True)], ["query_id", "row", "vec_id", "score"])

    return task


def _walk(points: DataFrame, queries: DataFrame, width: int, shards: int, k: int) -> DataFrame:
    """(query_id, row, vec_id, score): each shard's best for its queries (shard, row, vec_id, v, floor)."""
    both = points.select("shard", F.lit(False).alias("is_query"), F.lit(0).cast("long").alias("row"), "vec_id", "v", F.lit(0.0).alias("floor")).union(queries.select("shard", F.lit(True), "row", "vec_id", "v", "floor"))
    dealt = both.repartition(min(shards, 4096), "shard").sortWithinPartitions("shard", "is_query")
    return dealt.mapInArrow(_search(width, k), "query_id long, row long, vec_id long, score long")


def top_k(table: DataFrame, k: int = TOP, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row whose vec_id is divisible by `every`, against all rows."""
    rows = stored(quantised(table), "vectors")
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    shards = max(1, min(SHARDS, -(-n // SHARD)))
    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    points = rows.select(home.alias("shard"), "vec_id", "v")
    queries = stored(points.where(F.col("vec_id") % every == 0).withColumn("row", F.monotonically_increasing_id()), "queries")
    none = float("-inf")
    first = stored(_walk(points, queries.withColumn("floor", F.lit(none)), width or 0, shards, k), "first")
    kth = first.groupBy("row").agg(F.when(F.count("*") == k, F.min("score").cast("double")).otherwise(none).alias("floor"))
    others = queries.join(kth, "row", "left").select(F.explode(F.expr(f"filter(sequence(0, {shards - 1}), s -> s <> shard)")).alias("shard"), "row", "vec_id", "v", F.coalesce("floor", F.lit(none)).alias("floor"))
    found = first.union(_walk(points, others, width or 0, shards, k)) if shards > 1 else first
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""


def op6_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
