"""Run tables and the whitelisted queries over them.

Tables are Parquet partitioned by run_id; ingesting a run again replaces its partition only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom import functions as fn

KEYS = {"candidates": ["lane", "candidate_id"], "stories": ["story_id"], "claims": ["claim_id"], "documents": ["document_id"], "notifications": ["notification_id"], "artifacts": ["artifact_key"], "runs": []}
LANES = ("main", "supplemental")


def clamp(limit: int | str | None, default: int = 20) -> int:
    """A limit from 1 to 500."""
    try:
        return min(max(int(limit), 1), 500)
    except (TypeError, ValueError):
        return default


class RunStore:
    """Tables of runs under one path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        if name not in KEYS:
            raise ValueError(f"unknown table {name!r}")
        return f"{self.root}/{name}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def ingest(self, run_id: str, name: str, rows: DataFrame, ordinal: str | None = None) -> None:
        """Replaces a run's rows; of rows with one key the last by ``ordinal`` stays."""
        keys = KEYS[name]
        if keys and ordinal:
            by = W.partitionBy(*keys).orderBy(F.desc(ordinal))
            rows = rows.withColumn("_rn", F.row_number().over(by)).where("_rn = 1").drop("_rn")
        rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(self.path(name))

    def runs(self, limit: int = 20) -> DataFrame:
        """Runs, the latest first by end, start, id."""
        when = F.coalesce(F.nullif("ended_at", F.lit("")), F.nullif("started_at", F.lit("")), F.col("run_id"))
        return self.table("runs").orderBy(when.desc(), F.desc("run_id")).limit(clamp(limit))

    def latest(self) -> str | None:
        r = self.runs(1).select("run_id").first()
        return r.run_id if r else None

    def _of(self, name: str, run_id: str | None, equal: dict[str, str]) -> DataFrame:
        df = self.table(name).where(F.col("run_id") == (run_id or self.latest()))
        for c, v in equal.items():
            if v:
                df = df.where(F.col(c) == v)
        return df

    def stories(self, run_id: str | None = None, theme_section: str = "", limit: int = 20) -> DataFrame:
        return self._of("stories", run_id, {"theme_section": theme_section}).orderBy(F.desc("story_score"), "story_id").limit(clamp(limit))

    def candidates(self, run_id: str | None = None, lane: str = "", theme_section: str = "", source_id: str = "", limit: int = 20) -> DataFrame:
        df = self._of("candidates", run_id, {"lane": lane, "theme_section": theme_section, "source_id": source_id})
        return df.orderBy(F.desc("heat_score"), F.desc("published_at"), F.desc("observed_at"), "candidate_id").limit(clamp(limit))

    def notifications(self, run_id: str | None = None, severity: str = "", status: str = "", limit: int = 50) -> DataFrame:
        """Severity falls in the order of the alphabet: warning, info, error."""
        return self._of("notifications", run_id, {"severity": severity, "status": status}).orderBy(F.desc("severity"), "notification_id").limit(clamp(limit, 50))

    def artifacts(self, run_id: str | None = None, stage: str = "", limit: int = 100) -> DataFrame:
        return self._of("artifacts", run_id, {"stage": stage}).orderBy("stage", "artifact_key", "path").limit(clamp(limit, 100))

    def quality_flags(self, run_id: str | None = None, min_title_chars: int = 8, limit: int = 50) -> DataFrame:
        """Short titles of stories, documents without content, open notifications, in this order."""
        flag = lambda df, pos, name, item: df.select(F.lit(pos).alias("branch"), F.lit(name).alias("flag"), F.col(item).alias("item_id"))
        short = flag(self._of("stories", run_id, {}).where(F.length(fn.clean(F.col("title"))) < min_title_chars), 0, "short_title", "story_id")
        empty = flag(self._of("documents", run_id, {}).where(fn.clean(F.col("content")) == ""), 1, "empty_document_content", "document_id")
        open_ = flag(self._of("notifications", run_id, {}).where("status = 'open'"), 2, "open_notification", "notification_id")
        return short.unionByName(empty).unionByName(open_).orderBy("branch", "item_id").limit(clamp(limit, 50))

    def summary(self, run_id: str | None = None) -> DataFrame:
        """(table, n) of a run's rows, and its open notifications."""
        out = None
        for name in (k for k in KEYS if k != "runs"):
            n = self._of(name, run_id, {}).agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n"))
            out = n if out is None else out.unionByName(n)
        opened = self._of("notifications", run_id, {"status": "open"}).agg(F.lit("open_notifications").alias("table"), F.count(F.lit(1)).alias("n"))
        return out.unionByName(opened)

    def query(self, query_type: str, **options) -> DataFrame:
        """One of the whitelisted queries by name."""
        allowed: dict[str, Callable[..., DataFrame]] = {
            "runs": self.runs, "run_summary": self.summary, "stories": self.stories, "candidates": self.candidates, "notifications": self.notifications, "artifacts": self.artifacts, "quality_flags": self.quality_flags,
        }
        if query_type not in allowed:
            raise ValueError(f"unknown query {query_type!r}; known: {', '.join(allowed)}")
        return allowed[query_type](**options)


def upsert(stored: DataFrame, new: DataFrame, key: str, first: list[str], total: list[str] = ()) -> DataFrame:
    """New rows over stored ones: ``first`` columns keep the earliest value, ``total`` columns add up, others are replaced."""
    s, n = stored.alias("s"), new.alias("n")
    both = s.join(n, key, "full_outer")
    pick = lambda c: F.least(f"s.{c}", f"n.{c}") if c in first else F.coalesce(f"s.{c}", F.lit(0)) + F.coalesce(f"n.{c}", F.lit(0)) if c in total else F.coalesce(f"n.{c}", f"s.{c}")
    return both.select(key, *(pick(c).alias(c) for c in stored.columns if c != key))


def duplicates_across_runs(candidates: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Pairs of candidates of different runs on one host whose titles' words have a Jaccard index of ``threshold``."""
    from newsloom.operators.clusters import token_pairs

    host = fn.url_host(fn.canonical_url(F.col("url")))
    pairs = token_pairs(candidates.where(host != ""), "candidate_no", fn.tokens(F.col("title")), host, threshold)
    run = lambda s: candidates.select(F.col("candidate_no").alias(f"id_{s}"), F.col("run_id").alias(f"run_{s}"))
    return pairs.join(run("a"), "id_a").join(run("b"), "id_b").where("run_a <> run_b").select("id_a", "id_b", "similarity")
