"""Late reposts beside the stream of sightings: one keyed state, two tables, no row lost.

A watermark drops what comes too late. Here every sighting of a story passes a keyed state that knows
when the story was first seen; a story seen again after its lookback without news in it is a late
repost and goes to a table of its own, as does a sighting that is older than the key's newest by more
than the allowed delay. All others go to the table of sightings. Both tables are written by micro-batch
id, so a batch that is run again replaces its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "memory_key string, ts timestamp, row string, memory_status string, route string, first_seen_at timestamp, seen_count long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def append_once(df: DataFrame, batch_id: int, path: str, by: list[str] = ()) -> None:
    """Appends a micro-batch to a table of Parquet under ``path``; the same batch again replaces what it wrote before.

    The batch is the outermost partition column, so a replay overwrites its own partition alone, and
    an empty replay leaves nothing of an earlier attempt.
    """
    folder = f"{path.rstrip('/')}/batch_id={int(batch_id)}"
    df.write.mode("overwrite").partitionBy(*by).parquet(folder) if by else df.write.mode("overwrite").parquet(folder)


class _Sightings(StatefulProcessor):
    def __init__(self, lookback_us: int, delay_us: int, forget_ms: int | None):
        self.lookback, self.delay, self.forget = lookback_us, delay_us, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        schema = "first_us long, last_us long, seen long"
        self.seen = handle.getValueState("seen", schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["us", "row"], kind="stable")
        first, last, n = self.seen.get() if self.seen.exists() else (None, None, 0)
        out = []
        for us, row, current in zip(batch["us"].tolist(), batch["row"].tolist(), batch["is_update"].tolist(), strict=True):
            if first is None:
                status = "new_story"
            elif us - first <= self.lookback:
                status = "known_recent_story"
            else:
                status = "follow_up_update" if current else "late_repost"
            behind = last is not None and us < last - self.delay
            first, last, n = us if first is None else min(first, us), us if last is None else max(last, us), n + 1
            out.append((key[0], us, row, status, "late" if behind or status == "late_repost" else "sighting", first, n))
        self.seen.update((first, last, n))
        if self.forget is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.forget)
        made = pd.DataFrame(out, columns=["memory_key", "ts", "row", "memory_status", "route", "first_seen_at", "seen_count"])
        for c in ("ts", "first_seen_at"):
            made[c] = pd.to_datetime(made[c], unit="us")
        yield made

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def sightings(stream: DataFrame, key: Column, ts: Column, is_update: Column, lookback_hours: float = 48, delay_hours: float = 48, forget_after_hours: float | None = None) -> DataFrame:
    """Every row of the stream that has a key and a time, as JSON, with its status and the table it goes to.

    Rows of one micro-batch are taken by time, those of one time by their text. A story is forgotten
    ``forget_after_hours`` of processing time after its last sighting, by a timer (None: never). With
    timers a stream runs on without new data, so a trigger that should end needs
    spark.sql.streaming.noDataMicroBatches.enabled set to false. Needs the RocksDB state store (``PROVIDER``).
    """
    whole = F.to_json(F.struct(*[F.col(c) for c in stream.columns]))
    rows = stream.select(key.cast("string").alias("k"), F.unix_micros(ts.cast("timestamp")).alias("us"), F.coalesce(is_update, F.lit(False)).alias("is_update"), whole.alias("row")).where("k is not null and us is not null")
    hour = 3_600_000_000
    forget = None if forget_after_hours is None else int(forget_after_hours * 3_600_000)
    return rows.groupBy("k").transformWithStateInPandas(_Sightings(int(lookback_hours * hour), int(delay_hours * hour), forget), OUT, "Append", "None" if forget is None else "ProcessingTime")


def write_routes(found: DataFrame, path: str, checkpoint: str, **trigger):
    """Starts the stream of ``sightings`` into two tables under ``path``: sightings and late; each micro-batch is computed once for both."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, route in (("sightings", "sighting"), ("late", "late")):
                append_once(batch.where(F.col("route") == route).drop("route"), batch_id, f"{path.rstrip('/')}/{name}")
        finally:
            batch.unpersist()

    return found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def routed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of both tables with their route."""
    read = lambda name, route: spark.read.schema(f"{OUT.replace('route string, ', '')}, batch_id long").parquet(f"{path.rstrip('/')}/{name}").withColumn("route", F.lit(route))
    return read("sightings", "sighting").unionByName(read("late", "late"))
