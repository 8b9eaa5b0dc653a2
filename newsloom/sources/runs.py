"""Run folders: the JSON artifacts of past runs as tables, all folders in one pass, and what each folder holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import functions as fn

# The list artifacts of a run folder, their tables and lanes.
ARTIFACTS = [
    ("raw_sources.jsonl", "raw_sources", ""), ("candidates.json", "candidates", "main"), ("supplemental_candidates.json", "candidates", "supplemental"), ("rejected_candidates.json", "candidates", "rejected"),
    ("documents.json", "documents", ""), ("evidence_chunks.json", "evidence_chunks", ""), ("claims.json", "claims", ""), ("claim_verifications.json", "claim_verifications", ""), ("story_candidates.json", "story_candidates", ""),
    ("stories.json", "stories", ""), ("platform_posts.json", "platform_posts", ""), ("user_notifications.json", "user_notifications", ""),
]
TABLES = sorted({t for _, t, _ in ARTIFACTS})
# The first of these that an item has names it; an item without any is named by a digest of itself.
_IDS = ("notification_id", "chunk_id", "claim_id", "story_id", "candidate_id", "document_id", "id")


def artifact_rows(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(run_id, table_name, lane, item_no, item_id, title, url, source_id, theme_section, raw_json) of all list artifacts under the folders.

    A run's id is its folder's name. Files that are not there give no rows, a file that is no JSON list
    gives none either, and items that are no objects are left out. Of items with one id in a table, lane
    and run the last stays, so that a run that is imported again changes nothing.
    """
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,jsonl}").text(folders)
    at = F.col("_metadata.file_path")
    named = files.select(F.element_at(F.split(at, "/"), -1).alias("file"), F.url_decode(F.element_at(F.split(at, "/"), -2)).alias("run_id"), "value")
    table = F.create_map(*(x for f, t, lane in ARTIFACTS for x in (F.lit(f), F.struct(F.lit(t).alias("table_name"), F.lit(lane).alias("lane")))))
    known = named.withColumn("of", F.try_element_at(table, F.col("file"))).where("of is not null")
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    items = F.when(F.endswith("file", F.lit(".jsonl")), lines).otherwise(F.from_json("value", "array<string>"))
    rows = known.select("run_id", "of.table_name", "of.lane", F.posexplode(items).alias("item_no", "raw_json")).where(F.startswith(F.trim("raw_json"), F.lit("{")))
    get = lambda k: F.get_json_object("raw_json", f"$.{k}")
    item_id = F.coalesce(*(F.nullif(fn.clean(get(k)), F.lit("")) for k in _IDS), fn.short_hash(F.col("raw_json"), "item_"))
    rows = rows.withColumn("item_id", item_id)
    fields = F.struct("item_no", get("title").alias("title"), get("url").alias("url"), get("source_id").alias("source_id"), get("theme_section").alias("theme_section"), "raw_json")
    return rows.groupBy("run_id", "table_name", "lane", "item_id").agg(F.max_by(fields, "item_no").alias("f")).select("run_id", "table_name", "lane", "item_id", "f.*")


def import_runs(spark: SparkSession, folders: list[str], root: str) -> DataFrame:
    """Writes the artifacts of the folders below ``root``, by table and run; gives (run_id, table_name, n).

    A run that is there already is replaced as a whole, others stay.
    """
    rows = artifact_rows(spark, folders)
    for name in TABLES:
        part = rows.where(F.col("table_name") == name).drop("table_name")
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root.rstrip('/')}/{name}")
    return rows.groupBy("run_id", "table_name").agg(F.count(F.lit(1)).alias("n"))


def manifest(spark: SparkSession, folders: list[str], stages: dict[str, list[str]]) -> DataFrame:
    """(run_id, stage, file_name, exists, size_bytes): the files that each stage should leave in each folder that has any file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folders).select("path", "length")
    have = files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.url_decode(F.element_at(F.split("path", "/"), -2)).alias("run_id"), F.col("length").alias("size_bytes"))
    want = spark.range(1).select(F.explode(F.create_map(*(x for s, fs in stages.items() for x in (F.lit(s), F.array(*(F.lit(f) for f in fs)))))).alias("stage", "files")).select("stage", F.explode("files").alias("file_name"))
    every = have.select("run_id").distinct().crossJoin(F.broadcast(want))  # the stages' files: a fixed list
    out = every.join(have, ["run_id", "file_name"], "left")
    return out.select("run_id", "stage", "file_name", F.col("size_bytes").isNotNull().alias("exists"), F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"))
