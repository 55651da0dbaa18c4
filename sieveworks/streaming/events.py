"""Event logs as streams: the latest state of each key, and counts in windows with late events under a watermark.

An extension: the records' engine itself works on tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str, schema, pattern: str = "*.parquet", files_a_batch: int = 16) -> DataFrame:
    """Files of a folder, a bounded number in each batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def latest(events: DataFrame, key: str, order: tuple[str, ...], values: list[str]) -> DataFrame:
    """The last event of each key; one small state for each key, in update mode."""
    at = F.struct(*order)
    return events.groupBy(key).agg(*[F.max_by(v, at).alias(v) for v in values], F.count("*").alias("n_events"))


def windowed(events: DataFrame, time: str, kind: str, value: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and kind; events later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def run_once(df: DataFrame, path: str, mode: str, checkpoint: str) -> None:
    """Everything that is there, into a Parquet table: each batch's own folder in append mode, else the last state of all."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}" if mode == "append" else path)

    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
