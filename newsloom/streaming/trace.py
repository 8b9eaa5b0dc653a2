"""The run's trace and the decision log as streaming sinks: append-only tables in which a replayed batch leaves one copy."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.operators.event_store import decision_traces
from newsloom.streaming.late import append_once

EVENT = ("run_id", "event_type", "node_name", "stage", "created_at", "details")


def numbered_events(batch: DataFrame, before: DataFrame | None) -> DataFrame:
    """The events of a micro-batch with event_id evt_00001 and so on, which goes on from the run's events in ``before``.

    Events have run_id, event_type, created_at and event_no (their order among equal times); node_name,
    stage and details (a map) may be absent or null.
    """
    text = lambda c: (F.coalesce(F.col(c), F.lit("")) if c in batch.columns else F.lit("")).alias(c)
    details = F.to_json(F.coalesce("details", F.create_map().cast("map<string,string>"))) if "details" in batch.columns else F.lit("{}")
    rows = batch.select("run_id", "event_type", text("node_name"), text("stage"), "created_at", details.alias("details"), "event_no")
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("run_id").orderBy("created_at", "event_no")))
    if before is not None:
        rows = rows.join(before.groupBy("run_id").agg(F.count(F.lit(1)).alias("_before")), "run_id", "left")
    done = F.coalesce(F.col("_before"), F.lit(0)) if before is not None else F.lit(0)
    return rows.select(F.format_string("evt_%05d", F.col("_n") + done).alias("event_id"), *EVENT)


def _earlier(spark, path: str, batch_id: int) -> DataFrame | None:
    try:
        return spark.read.parquet(path).where(F.col("batch_id") < batch_id)
    except AnalysisException:
        return None


def event_sink(path: str):
    """For ``foreachBatch``: records the events of each micro-batch; a run's numbers follow those of earlier batches, also when a batch is replayed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        append_once(numbered_events(batch, _earlier(batch.sparkSession, path, batch_id)), batch_id, path)

    return write


def decision_sink(path: str, created_at: Column):
    """For ``foreachBatch``: records the decisions of each micro-batch, one row for each trace_id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        append_once(decision_traces(batch, created_at).dropDuplicates(["trace_id"]), batch_id, path)

    return write
