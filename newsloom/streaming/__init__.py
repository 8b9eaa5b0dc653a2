"""Structured Streaming: the running memory of seen stories, bounded lateness, micro-batch reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MEMORY = "memory_key string, first_seen_at timestamp, last_seen_at timestamp, seen_count long, batch_count long"
_STATE = "first_us long, last_us long, seen long"


def seen_memory(stream: DataFrame, key: str, ts: str, forget_after_hours: float | None = 24 * 30, late_hours: int = 48) -> DataFrame:
    """A stream of memory rows: for each key of a micro-batch its first and last time and number of sightings.

    State is held per key and forgotten ``forget_after_hours`` of event time after the last sighting
    (None: never). Rows more than ``late_hours`` behind the watermark may come late or not at all.
    """

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, last, seen = state.get if state.exists else (2**62, -(2**62), 0)
        n = 0
        for b in batches:
            us = b["us"].to_numpy()
            first, last, n = min(first, int(us.min())), max(last, int(us.max())), n + len(us)
        state.update((first, last, seen + n))
        if forget_after_hours is not None:
            state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + int(forget_after_hours * 3_600_000) + 1)
        at = lambda x: pd.Timestamp(x, unit="us")
        yield pd.DataFrame({"memory_key": [k[0]], "first_seen_at": [at(first)], "last_seen_at": [at(last)], "seen_count": [seen + n], "batch_count": [n]})

    timed = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(ts).cast("timestamp").alias("t")).withWatermark("t", f"{late_hours} hours")
    timed = timed.withColumn("us", F.unix_micros("t"))
    timeout = GroupStateTimeout.EventTimeTimeout if forget_after_hours is not None else GroupStateTimeout.NoTimeout
    return timed.groupBy("k").applyInPandasWithState(update, MEMORY, _STATE, "update", timeout)


def counts_per_window(stream: DataFrame, ts: str, key: str, window: str = "72 hours", slide: str = "24 hours", late: str = "48 hours") -> DataFrame:
    """Counts per key and sliding window, each final once the watermark has passed it."""
    timed = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", window, slide), key).agg(F.count(F.lit(1)).alias("n"))


def memory_of(spark: SparkSession, path: str, checkpoint: str, key: str, ts: str, name: str, max_files: int = 1) -> DataFrame:
    """Runs the memory over all files now under ``path`` and gives its last state per key."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    q = seen_memory(stream, key, ts, None).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table(name)
    return rows.groupBy("memory_key").agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.max("seen_count").alias("seen_count"))
