"""Result files as they land (SM1, SM2)."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import CELLS

KEY = ("scan_name", "image_name", "global_cell_id")


def read_stream(spark: SparkSession, path: str, schema: str = CELLS, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("header", "true").option("maxFilesPerTrigger", files_per_batch).csv(path)


def stream_results(stream: DataFrame, out: str, checkpoint: str, key: Sequence[str] = KEY) -> StreamingQuery:
    """Appends arriving cells to a Parquet table by scan, once each: rows whose key is stored already are dropped.

    Only the partitions of the batch's scans are compared, and a batch that is run again adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(list(key))
        scans = [r[0] for r in rows.select("scan_name").distinct().collect()]  # scans of one batch of files
        try:
            stored = spark.read.schema(batch.schema).parquet(out).where(F.col("scan_name").isin(*scans))
            rows = rows.join(stored.select(*key), list(key), "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.write.mode("append").partitionBy("scan_name").parquet(out)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_scan_totals(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Running totals of scans: each batch writes the scans it changed to a folder of its own.

    Sums live in the state store (there is no event time, so no watermark); nothing reaches the driver. A batch that is run
    again after a failure writes its own folder again, so it adds nothing twice."""
    totals = stream.groupBy("scan_name").agg(F.count("*").alias("n_cells"), F.sum("cell_area").alias("area"), F.count("cell_area").alias("n_areas"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return totals.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_scan_totals(spark: SparkSession, out: str) -> DataFrame:
    """(scan_name, n_cells, mean_area): of each scan the totals of the last batch that changed it."""
    rows = spark.read.schema("scan_name string, n_cells long, area double, n_areas long, batch long").parquet(out)
    last = rows.groupBy("scan_name").agg(F.max_by(F.struct("n_cells", "area", "n_areas"), "batch").alias("t"))
    return last.select("scan_name", "t.n_cells", (F.col("t.area") / F.col("t.n_areas")).alias("mean_area"))
