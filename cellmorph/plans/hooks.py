"""User code on tables: a model over tiles (UD4), run lengths as a table function (UD5)."""

from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..operators.pixels import expanded


class Model(Protocol):
    """What `score_tiles` asks of a user's model: arrays of some rows to arrays of as many results. It may raise."""

    def predict(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]: ...


def _array(column: pa.Array) -> np.ndarray:
    """A column as numpy; lists of one length as a matrix. Nulls and ragged lists are errors."""
    if column.null_count:
        raise ValueError("no value")
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False)
    flat = column.flatten()
    lengths = np.diff(column.offsets.to_numpy())
    if flat.null_count or len(set(lengths.tolist())) > 1:
        raise ValueError("lists with nulls or of several lengths")
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def score_tiles(tiles: DataFrame, model: Model, inputs: Sequence[str], outputs: str, rows: int = 1024) -> DataFrame:
    """tiles with the model's outputs (a schema string) and `error` (UD4).

    The model is broadcast: a Python process unpickles it once and keeps it for all its tasks. It sees batches of up to
    `rows` rows. If it raises, or gives another number of results, the batch is tried again row by row, and a row that
    fails alone has null outputs and the reason: one bad tile costs no job."""
    spark = tiles.sparkSession
    sent, wanted = spark.sparkContext.broadcast(model), StructType.fromDDL(outputs)
    types = [(f.name, to_arrow_type(f.dataType)) for f in wanted.fields]

    def scored(batch: pa.RecordBatch) -> list[pa.Array]:
        found = sent.value.predict({c: _array(batch.column(c)) for c in inputs})
        arrays = [pa.array(found[n], t) for n, t in types]
        if any(len(a) != batch.num_rows for a in arrays):
            raise ValueError("another number of results than rows")
        return [*arrays, pa.nulls(batch.num_rows, pa.string())]

    def careful(batch: pa.RecordBatch) -> list[list[pa.Array]]:
        try:
            return [scored(batch)]
        except Exception as e:  # a user's model may raise anything
            if batch.num_rows == 1:
                return [[*(pa.nulls(1, t) for _, t in types), pa.array([f"{type(e).__name__}: {e}"], pa.string())]]
            return [part for i in range(batch.num_rows) for part in careful(batch.slice(i, 1))]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, rows):
                batch = whole.slice(i, rows)
                parts = careful(batch)
                made = [pa.concat_arrays([p[k] for p in parts]) for k in range(len(types) + 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *(n for n, _ in types), "error"])

    return tiles.mapInArrow(task, ", ".join([*(f"`{c}` {t}" for c, t in tiles.dtypes), outputs, "error string"]))


class NearestCentroid:
    """A model of class means: the nearest mean's class and its squared distance."""

    def __init__(self, classes: Sequence[int], means: np.ndarray, column: str):
        self.classes, self.means, self.column = np.asarray(classes), np.asarray(means, float), column

    def predict(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        v = columns[self.column].astype(float)
        if v.shape[1] != self.means.shape[1]:
            raise ValueError(f"{v.shape[1]} numbers instead of {self.means.shape[1]}")
        d = ((v[:, None] - self.means) ** 2).sum(2)
        return {"predicted": self.classes[d.argmin(1)], "distance": d.min(1)}


def fit_centroids(df: DataFrame, label: str, vector: str) -> NearestCentroid:
    """The class means, which Spark sums; a row per class and dimension reaches the driver."""
    each = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(label).alias("c"), F.posexplode(F.col(vector).cast("array<double>")).alias("j", "x"))
    rows = each.groupBy("c", "j").agg(F.avg("x").alias("m")).orderBy("c", "j").collect()
    classes = sorted({r["c"] for r in rows})
    return NearestCentroid(classes, np.array([[r["m"] for r in rows if r["c"] == c] for c in classes]), vector)


def run_expander(schema: str, height: int):
    """A table function over run lengths, schema being its rows' (key, y long, x long); for SQL: spark.udtf.register(name, run_expander(...))."""

    @F.arrow_udtf(returnType=schema)
    class ExpandRuns:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            for i in range(0, batch.num_rows, 256):
                yield expanded(batch.slice(i, 256), height)

    return ExpandRuns


def expand_runs(runs: DataFrame, height: int, by: Sequence[str] = ()) -> DataFrame:
    """Run lengths (key, counts) as pixel rows (key, y, x) by a table function (UD5); dealt by the columns `by`, if any."""
    kinds = {c: t for c, t in runs.dtypes if c != "counts"}
    table = runs.select(*kinds, "counts").asTable()
    return run_expander(", ".join([*(f"{c} {t}" for c, t in kinds.items()), "y long, x long"]), height)(table.partitionBy(*by) if by else table)


def register_expand_runs(spark: SparkSession, schema: str, height: int, name: str = "expand_runs") -> None:
    """SELECT * FROM expand_runs(TABLE(runs) PARTITION BY key)."""
    spark.udtf.register(name, run_expander(schema, height))
