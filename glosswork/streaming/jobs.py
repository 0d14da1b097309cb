"""Streaming jobs over annotation and prediction events. Each run takes what has come since its last one (``availableNow``) and can be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.keyed_table import KeyedTable, newest_of


def merge_latest(stream: DataFrame, keys: list[str], order: str, folder: str, *, good: str = "true", buckets: int = 64) -> DataFrame:
    """The last good row of each key in order, over all that the stream has brought so far.

    A batch rewrites the buckets of its keys alone, as the version of its number, so
    that a batch that runs again writes the same.
    """
    table = KeyedTable(stream.sparkSession, f"{folder}/table", stream.schema, keys, buckets=buckets)

    def merge(batch: DataFrame, number: int) -> None:
        table.merge(batch.where(good), number, newest_of(keys, order))

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return table.read()


def progress_counts(stream: DataFrame, kind: str, folder: str, *, every: str = "1 day", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """start, kind, n: events of each kind in each window of time; state of windows that the watermark has passed is dropped."""
    spark = stream.sparkSession
    counts = stream.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "kind", "n", F.current_timestamp().alias("_at"))

    def add(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    counts.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/table")
    return rows.groupBy("start", "kind").agg(F.max_by("n", "_batch").alias("n"))
