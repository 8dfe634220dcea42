"""Incremental builds over a stream of arriving files: an extension, not part of the batch contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spandrel.operators import merge


def new_files(arrivals: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each content of a stream (sha256, arrived, ...) once, as long as its copies arrive within the delay."""
    return arrivals.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["sha256"])


def counts_per_window(events: DataFrame, size: str = "10 minutes", delay: str = "30 minutes") -> DataFrame:
    """Number and sum of events per window and type, once the watermark has passed it."""
    kept = events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type")
    return kept.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def merged_into(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Starts a query that adds the rows of each batch whose keys the table at path lacks.

    Each batch is written under its number, so a repeated batch replaces itself.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        if number:
            stored = spark.read.schema(batch.schema).option("recursiveFileLookup", True).parquet(path).filter(~F.col("_metadata.file_path").contains(f"/batch={number}/"))
            fresh = fresh.join(stored.select(keys), keys, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    return merge.upsert(stored, batch, keys)
