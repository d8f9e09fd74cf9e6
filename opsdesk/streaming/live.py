"""The same operators on streams (an addition: the tools this replaces have no streams).

Scans and rule packs are projections, so they run on a stream as they are. Aggregates and duplicates keep state that a
watermark bounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def windowed_totals(events: DataFrame, *, time: str = "ts", key: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum by key and window; state is dropped once the watermark has passed a window."""
    return _timed(events, time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def first_seen(events: DataFrame, keys: list[str], *, time: str = "ts", late: str = "2 hours") -> DataFrame:
    """Repeats of a key within the watermark are dropped."""
    return _timed(events, time, late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, *, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return _timed(events, time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), key, "n")


def run_on(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch through an operator into a parquet table; the batch number makes a repeated batch replace itself."""
    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
