"""Streams: running counts of events, and an idempotent sink for graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portloom.sources.text import append_new


def type_counts(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events of each type in each window; windows close when events are ``late`` behind."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def new_keys(rows: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Rows whose key didn't come within ``late`` before; state older than that goes."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def upsert(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: appends rows of new keys, so that a batch that runs again adds nothing. Batches are told apart by the query's id, which its checkpoint keeps, and their number."""

    def write(batch: DataFrame, epoch: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        append_new(batch, path, key, f"{query}-{epoch}")

    return write
