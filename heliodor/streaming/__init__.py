"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliodor.operators.store import PointStore


def with_watermark(events: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def tumbling(events: DataFrame, size: str = "1 day", *keys: str) -> DataFrame:
    return _windows(events, F.window("ts", size), *keys)


def sliding(events: DataFrame, size: str = "1 hour", step: str = "15 minutes", *keys: str) -> DataFrame:
    return _windows(events, F.window("ts", size, step), *keys)


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id") -> DataFrame:
    return _windows(events, F.session_window("ts", gap), key)


def _windows(events: DataFrame, window, *keys: str) -> DataFrame:
    found = events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def dedup_within(events: DataFrame, key: str, delay: str = "10 minutes") -> DataFrame:
    return with_watermark(events, delay=delay).dropDuplicatesWithinWatermark([key])


def rolling_tokens(events: DataFrame, seconds: int = 60, step: int = 10) -> DataFrame:
    """The rolling token sum as a sliding window."""
    return events.groupBy(F.window("ts", f"{seconds} seconds", f"{step} seconds").alias("w"), "session").agg(F.sum("tokens").alias("used")).select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "used")


def index_batches(files: DataFrame, store: PointStore, chunk: Callable[[DataFrame], DataFrame], checkpoint: str, name: str = "index"):
    """A stream that chunks new files and stores chunks that are not there yet, as one delta a batch.

    The store knows the last batch of each stream by its name, so a batch that is run again after a failure changes nothing."""

    def batch(df: DataFrame, number: int) -> None:
        store.upsert(store.missing(chunk(df)), batch=(name, number))

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
