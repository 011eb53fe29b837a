"""Streams: items are checked one by one, so a stream runs the batch transform; results append once by id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checked_stream(items: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str = "item_id", time_col: str | None = None, late: str = "1 day"):
    """Starts a query that appends each batch's results to a Parquet folder, an id once.

    Ids seen before are the stream's own keyed state, so a batch costs what it holds, however much was written before. With
    ``time_col``, ids are forgotten ``late`` after their time; without, they are kept for good. Rows without an id are
    told apart by all they hold.
    """
    told = F.coalesce(F.concat(F.lit("i"), F.col(key).cast("string")), F.concat(F.lit("r"), F.to_json(F.struct("*"))))
    marked = items.withColumn("_key", told)
    once = marked.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["_key"]) if time_col else marked.dropDuplicates(["_key"])

    def append(batch: DataFrame, number: int) -> None:
        # a batch that is run again overwrites its own folder, so nothing doubles
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return once.drop("_key").writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts and sums by window and type; on a stream, rows later than the watermark are left out."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type")
    return windowed.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", F.col("total").cast("double").alias("total"))
