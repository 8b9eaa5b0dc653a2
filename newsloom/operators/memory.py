"""The memory of seen stories as a table: records of what was seen under a key, brought up to date by a run's candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import functions as fn
from newsloom.operators.candidates import memory_key

RECORD = "memory_key string, first_seen_at timestamp, last_seen_at timestamp, seen_count long, titles array<string>, urls array<string>, source_ids array<string>, published_at_values array<timestamp>, title string, url string, source_id string"
_LISTS = {"titles": "title", "urls": "url", "source_ids": "source_id"}


def candidate_key(df: DataFrame) -> Column:
    """The first of memory_key, related_story_id and story_id that is there and not blank, else the URL, else a digest of the title; empty without any."""
    named = [F.nullif(fn.clean(F.col(c).cast("string")), F.lit("")) for c in ("memory_key", "related_story_id", "story_id") if c in df.columns]
    return F.coalesce(*named, memory_key())


def updated_records(records: DataFrame, candidates: DataFrame, ordinal: str, seen_at: Column) -> DataFrame:
    """``records`` (see RECORD) with the candidates (title, url, source_id, published_at, observed_at) seen at ``seen_at``, and ``state``: new, updated or kept.

    Lists gain values that they lack, in the order of the candidates; title, url and source_id become
    the last one given. Candidates without a key are left out (see ``update_stats``). Values of a key are
    made distinct before they meet, so a story that very many candidates tell is no list of them all.
    """
    rows = candidates.withColumn("_key", candidate_key(candidates)).where("_key <> ''").withColumn("_at", F.coalesce("published_at", "observed_at").cast("timestamp"))
    value = lambda name, c: F.struct(F.lit(name).alias("list"), fn.clean(F.col(c).cast("string")).alias("v"), F.lit(None).cast("timestamp").alias("t"))
    held = F.array(*(value(name, c) for name, c in _LISTS.items()), F.struct(F.lit("published_at_values").alias("list"), F.lit("").alias("v"), F.col("_at").alias("t")))
    told = rows.select("_key", F.col(ordinal).alias("o"), F.explode(held).alias("x")).where("x.v <> '' OR x.t IS NOT NULL")
    once = told.groupBy("_key", "x.list", "x.v", "x.t").agg(F.min("o").alias("first"), F.max("o").alias("last"))
    values = lambda name, c: F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == name, F.struct("first", F.col(c).alias("x"))))), lambda s: s["x"]).alias(f"_{name}")
    latest = lambda name, c: F.max(F.when(F.col("list") == name, F.struct("last", "v")))["v"].alias(f"_{c}")
    lists = once.groupBy("_key").agg(*(values(name, "v") for name in _LISTS), values("published_at_values", "t"), *(latest(name, c) for name, c in _LISTS.items()))
    seen = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).join(lists, "_key", "left").withColumnRenamed("_key", "_k")
    both = records.join(seen, records["memory_key"] == seen["_k"], "full_outer")
    new, met = F.col("memory_key").isNull(), F.col("_n").isNotNull()
    union = lambda name, kind: F.array_union(F.coalesce(name, F.array().cast(kind)), F.coalesce(f"_{name}", F.array().cast(kind))).alias(name)
    return both.select(
        F.coalesce("memory_key", "_k").alias("memory_key"), F.when(new, seen_at).otherwise(F.col("first_seen_at")).alias("first_seen_at"), F.when(met, seen_at).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        (F.coalesce("seen_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("seen_count"), *(union(name, "array<string>") for name in _LISTS), union("published_at_values", "array<timestamp>"),
        *(F.coalesce(f"_{c}", c, F.lit("")).alias(c) for c in _LISTS.values()), F.when(new, "new").when(met, "updated").otherwise("kept").alias("state"),
    )


def update_stats(updated: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: total_records, new_records, updated_records (candidates that met a record, or one of this run) and skipped_records (candidates without a key)."""
    r = updated.agg(F.count(F.lit(1)).alias("total_records"), F.count(F.when(F.col("state") == "new", 1)).alias("new_records"))
    c = candidates.select(candidate_key(candidates).alias("k")).agg(F.count(F.when(F.col("k") != "", 1)).alias("_seen"), F.count(F.when(F.col("k") == "", 1)).alias("skipped_records"))
    return r.crossJoin(c).select("total_records", "new_records", (F.col("_seen") - F.col("new_records")).alias("updated_records"), "skipped_records")  # one row each
