"""Shared helpers: stored intermediate tables, text columns for Arrow tasks, a connected-components job."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import discard, shared_dir, stored  # noqa: F401 - for the operators


_kept: dict = {}


def kept(key, make):
    """The process's object of a key, made once (asked for with another key, others are freed). Only that asked for last stays: tasks of one operator share it, and the
    next operator's tasks, which run in the same processes, don't add theirs to it."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def dealt(df: DataFrame) -> DataFrame:
    """df as a join's side that is shuffled, never broadcast. Spark's estimate goes by the bytes of a file, however packed, and takes a row
    that is exploded for one row, so that gigabytes can look small; a broadcast holds all of them in the driver."""
    return df.hint("merge")


def slices(batches, rows: int = 1000):
    """Arrow batches in slices, so that a task holds few rows as Python objects at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id (long) and text (string, null as empty): other columns of docs never reach the tasks."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def crc_mod(col: str, mod: int):
    """crc32 of the decimal text of an id, modulo mod; null for a null id."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(mod))


def min_labels(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b): one row (id, label) per vertex, label the smallest id reachable.

    Alternates two steps until nothing changes: every vertex sends its larger neighbours to its smallest
    one, then every vertex sends its smaller neighbours there. Only minima are gathered per vertex (with
    partial aggregation), so a vertex with very many edges is no large group, and each round is stored.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    size = _size(edges)
    while size[0]:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        last, edges = edges, stored(small.where("a <> b").distinct(), "edges")
        discard(last, large)
        now = _size(edges)
        if now == size:
            break
        size = now
    ids = edges.select(F.col("a").alias("id"), F.col("b").alias("label"))
    return ids.union(edges.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())


def _size(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]
