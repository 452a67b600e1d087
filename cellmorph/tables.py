"""Intermediate tables in the folder that executors share, and connected components over an edge table."""

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder set on the context. In local mode, where the driver's disk is all there is, a temporary folder stands in; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    import tempfile

    base = tempfile.mkdtemp(prefix="cellmorph-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/cellmorph-{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back, so that lost executors cost no recomputation."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_path)
        where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def min_labels(edges: DataFrame) -> DataFrame:
    """(id, label) of every vertex of edges (a, b): the smallest vertex it is connected to. Vertices are of any type that can be ordered.

    Edges run from larger to smaller. In turn, vertices hand the larger ones next to them, then the smaller ones, to the smallest
    next to them, so that paths shrink to stars. A vertex meets only minima, whatever its degree; every round is stored."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(now):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        larger = stored(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "edges")
        joined = larger.join(larger.groupBy("a").agg(F.min("b").alias("m")), "a")
        ends = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        smaller = stored(joined.select(ends.alias("e")).select("e.*").where("a <> b").distinct(), "edges")
        discard(now, larger)
        now = smaller
    ids = now.select(F.col("a").alias("id"), F.col("b").alias("label"))
    return ids.union(now.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every vertex with a smaller one has just one, which has none itself."""
    several = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
    return several.isEmpty() and edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()


def _differs(column: pa.ChunkedArray) -> np.ndarray:
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    changed = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
    return changed.to_numpy()


def whole_groups(batches: Iterator[pa.RecordBatch], key: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of batches sorted by key: tables of whole groups and the rows at which a group begins. A group that a batch's end cuts goes on in the next one."""

    def cut(table: pa.Table) -> np.ndarray:
        return np.concatenate(([0], np.flatnonzero(np.logical_or.reduce([_differs(table[k]) for k in key])) + 1)) if table.num_rows > 1 else np.arange(table.num_rows)

    left = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([left, table]) if left is not None else table
        starts = cut(table)
        if len(starts):
            if len(starts) > 1:
                yield table.slice(0, starts[-1]), starts[:-1]
            left = table.slice(starts[-1])
    if left is not None:
        yield left, cut(left)
