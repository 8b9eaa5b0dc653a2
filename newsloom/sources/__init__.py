"""Sources and sinks: JSON, JSON lines, RSS, HTML pages, listings, JSONP, source catalogs, run tables.

Pages and feeds are landed as files by a fetcher outside the engine; these functions read and parse
them in parallel.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom import functions as fn
from newsloom.functions.python import parse_page

CANDIDATE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("title", "url", "source_id", "snippet", "query")]
    + [T.StructField("discovered_at", T.TimestampType()), T.StructField("published_at", T.TimestampType()), T.StructField("observed_at", T.TimestampType())]
    + [T.StructField("heat_signals", T.MapType(T.StringType(), T.DoubleType())), T.StructField("tags", T.ArrayType(T.StringType()))]
)
SOURCE = T.StructType(
    [T.StructField("source_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("priority", T.IntegerType()), T.StructField("collector", T.StringType())]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("tags", "allowed_url_patterns", "excluded_url_patterns", "excluded_keywords", "required_any_keywords")]
)
COLLECTORS = ("rss", "listing", "incremental_listing", "jsonp_listing")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str = CANDIDATE) -> DataFrame:
    """Files of one JSON value each (an array gives a row per element)."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str = CANDIDATE) -> DataFrame:
    """JSON lines; blank lines give nothing, broken ones a row of nulls."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_sources(spark: SparkSession, path: str | Path) -> DataFrame:
    """A source catalog in YAML (if a YAML reader is there) or JSON: one row per source, checked."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml

        entries = yaml.safe_load(text)
    except ImportError:
        entries = json.loads(text)
    entries = entries.get("sources", []) if isinstance(entries, dict) else entries
    rows = []
    for e in entries:
        config = e.get("collector_config") or {}
        priority = int(e.get("priority", 50))
        if not e.get("id") or e.get("kind") not in ("official", "media", "community", "search") or not 0 <= priority <= 100:
            raise ValueError(f"source {e.get('id')!r}: an id, a known kind and a priority from 0 to 100 are needed")
        lists = [[v] if isinstance(v := config.get(k), str) else v for k in ("allowed_url_patterns", "excluded_url_patterns", "excluded_keywords", "required_any_keywords")]
        rows.append((e["id"], e.get("name", e["id"]), e["kind"], priority, e.get("collector", ""), e.get("tags") or [], *lists))
    return spark.createDataFrame(rows, SOURCE)


def live_collectible(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("collector").isin(*COLLECTORS))


def rss_time(text: Column) -> Column:
    """RFC 822 or ISO time, null if neither."""
    t = F.regexp_replace(fn.clean(text), "^[A-Za-z]{3}, *", "")
    t = F.regexp_replace(t, "(GMT|UTC|Z)$", "+0000")
    return F.coalesce(F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(fn.clean(text)))


def rss_candidates(spark: SparkSession, path: str, source_id: str, discovered_at: Column) -> DataFrame:
    """The items of RSS files that have a title and a link, as candidates."""
    item = "title string, link string, description string, pubDate string, published string, category array<string>"
    items = spark.read.format("xml").option("rowTag", "item").schema(item).load(path)
    when = rss_time(F.coalesce("pubDate", "published"))
    tags = F.filter(F.coalesce("category", F.array().cast("array<string>")), lambda c: fn.clean(c) != "")
    return items.where((fn.clean(F.col("title")) != "") & (fn.clean(F.col("link")) != "")).select(
        fn.clean(F.col("title")).alias("title"), fn.clean(F.col("link")).alias("url"), F.lit(source_id).alias("source_id"), fn.clean(F.col("description")).alias("snippet"), F.lit("").alias("query"), discovered_at.alias("discovered_at"),
        when.alias("published_at"), when.alias("observed_at"), F.create_map().cast("map<string,double>").alias("heat_signals"), F.transform(tags, F.trim).alias("tags"),
    )


def documents(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Pages as documents: title, published_at, content, image_urls, error (empty_document_content or null)."""
    parsed = pages.withColumn("_p", parse_page(url, html))
    out = parsed.withColumns({"title": F.col("_p.title"), "published_at": rss_time(F.col("_p.published")), "content": F.col("_p.content"), "image_urls": F.array_distinct("_p.images")})
    return out.withColumn("error", F.when(fn.clean(F.col("content")) == "", "empty_document_content")).drop("_p", html)


def image_assets(docs: DataFrame, url: str = "url") -> DataFrame:
    """Distinct (source url, image url) pairs of documents."""
    return docs.select(F.col(url).alias("source_url"), F.explode("image_urls").alias("image_url")).distinct()


def jsonp_body(text: Column) -> Column:
    """The JSON object in a JSON or JSONP response as a variant; null if there is none."""
    t = fn.clean(text)
    inner = F.regexp_extract(t, r"(?s)^[\w$.]+\s*\((.*)\)\s*;?\s*$", 1)
    return F.try_parse_json(F.when(inner != "", inner).otherwise(t))


_UNITS = {"m": 60, "h": 3600, "d": 86400, "w": 604800}


def listing_time(text: Column, discovered_at: Column) -> Column:
    """When a listing entry was posted: relative time first, then dates and day words in UTC+8."""
    t = F.coalesce(text, F.lit(""))
    start, ago = r"(?i)^\s*(\d{1,3})\s*(m|h|d|w)\b", r"(?i)\b(\d{1,3})\s*(m|h|d|w|mins?|minutes?|hrs?|hours?|days?|weeks?)\s*ago\b"
    seconds = lambda p: F.try_to_number(F.regexp_extract(t, p, 1), F.lit("999")).cast("long") * fn.lookup(F.substring(F.lower(F.regexp_extract(t, p, 2)), 1, 1), _UNITS, 0)
    back = F.coalesce(F.when(t.rlike(start), seconds(start)), F.when(t.rlike(ago), seconds(ago)))
    relative = F.timestamp_micros(F.unix_micros(discovered_at) - back * 1_000_000)
    local = F.from_utc_timestamp(discovered_at, "+08:00")
    wall = lambda y, m, d, p, h: F.to_utc_timestamp(F.try_to_timestamp(F.concat_ws(" ", F.concat_ws("-", y, m, d), F.concat_ws(":", F.regexp_extract(t, p, h), F.regexp_extract(t, p, h + 1))), F.lit("y-M-d H:m")), "+08:00")
    part = lambda p, i: F.regexp_extract(t, p, i)
    full, short = r"(20\d{2})[-/年.](\d{1,2})[-/月.](\d{1,2})\s*(?:日)?\s+(\d{1,2}):(\d{2})", r"(?<!\d)(\d{1,2})[-/](\d{1,2})\s+(\d{1,2}):(\d{2})"
    today, before = r"(今天|今日)\s*(\d{1,2}):(\d{2})", r"昨天\s*(\d{1,2}):(\d{2})"
    ymd = lambda x: (F.date_format(x, "yyyy"), F.date_format(x, "M"), F.date_format(x, "d"))
    return F.coalesce(
        relative, F.when(t.rlike(full), wall(part(full, 1), part(full, 2), part(full, 3), full, 4)), F.when(t.rlike(short), wall(F.date_format(local, "yyyy"), part(short, 1), part(short, 2), short, 3)),
        F.when(t.rlike(today), wall(*ymd(local), today, 2)), F.when(t.rlike(before), wall(*ymd(local - F.expr("INTERVAL 1 DAY")), before, 1)),
    )


def listing_candidates(pages: DataFrame, url: str, html: str, discovered_at: Column, allowed: str = ".*") -> DataFrame:
    """Links of listing pages as candidates (url, title, published_at): absolute, allowed, distinct, with a title."""
    links = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"'][^\"']+[\"'][^>]*>.*?</a>(?:(?!<a\b).){0,200}"), F.lit(0))
    rows = pages.select(F.col(url).alias("page_url"), F.posexplode(links).alias("pos", "link"))
    href = F.regexp_extract("link", r"(?is)\bhref\s*=\s*[\"']([^\"']+)[\"']", 1)
    root = F.regexp_extract("page_url", r"^[^:]+://[^/?#]+", 0)
    absolute = F.when(href.rlike("^[a-z]+://"), href).when(href.rlike("^//"), F.concat(F.lit("https:"), href)).when(href.rlike("^/"), F.concat(root, href)).when(href.rlike("^(#|javascript:|mailto:)"), F.lit("")).otherwise(F.concat(F.regexp_replace(F.regexp_replace("page_url", "[?#].*$", ""), "[^/]*$", ""), href))
    shown = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("link", r"(?is)>(.*?)</a>", 1), "<[^>]+>", " "), r"\s+", " "))
    title = F.regexp_replace(shown, r"(?i)^\d{1,3}\s*(m|h|d|w)\b\s*", "")
    near = F.regexp_replace("link", "<[^>]+>", " ")
    out = rows.select("page_url", "pos", absolute.alias("url"), title.alias("title"), listing_time(near, discovered_at).alias("published_at"))
    out = out.where((F.col("url") != "") & (F.col("title") != "") & F.col("url").rlike(allowed))
    return out.groupBy("url").agg(F.min_by(F.struct("title", "published_at", "page_url"), F.struct("page_url", "pos")).alias("f"), F.count(F.lit(1)).alias("times_seen")).select("url", "f.title", "f.published_at", "f.page_url", "times_seen")


def page_is_stale(candidates: DataFrame, page: str, cutoff: Column) -> DataFrame:
    """(page, stale): a page with a time on it, all of them before the cutoff."""
    t = F.col("published_at")
    return candidates.groupBy(page).agg((F.coalesce(F.bool_and(t < cutoff), F.lit(False)) & (F.count(t) > 0)).alias("stale"))


def artifact_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, modified, sha256) of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def synthetic_documents(candidates: DataFrame, fetched_at: Column, ordinal: str, limit: int) -> DataFrame:
    """The first ``limit`` candidates as documents made of their title and snippet, for runs without fetching; marked as synthetic."""
    title, text = F.coalesce("title", F.lit("")), lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    first = candidates.orderBy(ordinal).limit(max(limit, 0))
    return first.select(
        F.coalesce("url", F.lit("")).alias("candidate_url"), F.when(title != "", title).otherwise(F.coalesce("url", F.lit(""))).alias("title"), F.coalesce("source_id", F.lit("")).alias("source_id"), F.trim(F.concat_ws("\n", text("title"), text("snippet"))).alias("content"),
        F.coalesce("published_at", "observed_at").alias("published_at"), fetched_at.alias("fetched_at"), F.array().cast("array<string>").alias("image_urls"), F.lit(True).alias("dry_run_synthetic"),
    )


def write_json(df: DataFrame, path: str) -> None:
    """Files of one JSON array each, a file for each partition of ``df``, as ``read_json`` reads them; an empty table gives one empty array."""
    rows = df.select(F.spark_partition_id().alias("p"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("j"))
    arrays = rows.groupBy("p").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value")).select("value")
    empty = df.sparkSession.range(1).select(F.lit("[]").alias("value"))
    (empty if df.isEmpty() else arrays).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
