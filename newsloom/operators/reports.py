"""Reports by source: theme counts, collector and selection diagnostics, warnings, recovery, probe and heat summaries.

Each takes the stage tables that it sums up, tags them, and counts all in one aggregation by source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import functions as fn
from newsloom.operators import rules as R

SECTIONS = [*R.SECTIONS, R.SUPPLEMENTAL]


def _tagged(tables: dict[str, tuple[DataFrame, dict[str, Column]]], names: list[str]) -> DataFrame:
    """The rows of all tables as (source_id, what, names...); a name that a table does not give is null."""
    parts = []
    for what, (df, cols) in tables.items():
        given = [cols[n].cast("string").alias(n) if n in cols else F.lit(None).cast("string").alias(n) for n in names]
        parts.append(df.select(F.coalesce(F.col("source_id").cast("string"), F.lit("unknown")).alias("source_id"), F.lit(what).alias("what"), *given))
    return reduce(DataFrame.unionByName, parts)


def _n(condition: Column | str) -> Column:
    c = F.expr(condition) if isinstance(condition, str) else condition
    return F.sum(F.when(c, 1).otherwise(0))


def _counts(rows: DataFrame, value: str, name: str) -> DataFrame:
    """(source_id, name): a map from each value to its number of rows. Values are few (reasons, scopes, fields)."""
    n = rows.groupBy("source_id", value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("source_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias(name))


def source_theme_counts(raw_fetches: DataFrame, raw_candidates: DataFrame, main: DataFrame, supplemental: DataFrame, rejected: DataFrame) -> DataFrame:
    """Per source: fetches, raw, main, supplemental, accepted and rejected counts, theme counts in all and by lane, reject reasons.

    Main and supplemental candidates have theme_section, rejected ones reject_reason.
    """
    section = F.when(F.col("theme_section").isin(SECTIONS), F.col("theme_section")).otherwise(F.lit(R.SUPPLEMENTAL))
    rows = _tagged(
        {"fetch": (raw_fetches, {}), "raw": (raw_candidates, {}), "main": (main, {"v": section}), "supplemental": (supplemental, {"v": section}), "rejected": (rejected, {"v": F.coalesce("reject_reason", F.lit("unknown"))})}, ["v"]
    )
    lanes = {"theme": "what in ('main', 'supplemental')", "main": "what = 'main'", "supplemental": "what = 'supplemental'"}
    themes = [_n(f"{where} and v = '{s}'").alias(f"{lane}_{s}") for lane, where in lanes.items() for s in SECTIONS]
    out = rows.groupBy("source_id").agg(
        _n("what = 'fetch'").alias("raw_fetch_count"), _n("what = 'raw'").alias("raw_candidate_count"), _n("what = 'main'").alias("main_count"), _n("what = 'supplemental'").alias("supplemental_count"),
        _n("what in ('main', 'supplemental')").alias("accepted_count"), _n("what = 'rejected'").alias("rejected_count"), *themes,
    )
    return out.join(_counts(rows.where("what = 'rejected'"), "v", "reject_reasons"), "source_id", "left")


def collector_diagnostics(sources: DataFrame, raw_fetches: DataFrame, candidates: DataFrame, rejected: DataFrame, errors: DataFrame, entries: DataFrame) -> DataFrame:
    """Per source of ``sources`` (source_id, name, collector): fetches, entries and their sums, candidates, missing times, errors.

    Candidates have published_at and observed_at; entries have link_count, duplicate_url_count,
    detail_time_backfill_count, parse_warning_count.
    """
    metrics = ["link_count", "duplicate_url_count", "detail_time_backfill_count", "parse_warning_count"]
    untimed = F.when(F.col("published_at").isNull() & F.col("observed_at").isNull(), "missing_time")
    rows = _tagged(
        {"fetch": (raw_fetches, {}), "candidate": (candidates, {"v": untimed}), "rejected": (rejected, {"v": F.coalesce("reject_reason", F.lit("unknown"))}), "error": (errors, {}), "entry": (entries, {m: F.col(m) for m in metrics})},
        ["v", *metrics],
    )
    counts = rows.groupBy("source_id").agg(
        _n("what = 'fetch'").alias("raw_fetch_count"), _n("what = 'entry'").alias("entry_count"), _n("what = 'candidate'").alias("candidate_count"), _n("what = 'candidate' and v = 'missing_time'").alias("candidate_missing_time_count"),
        _n("what = 'rejected' and v = 'missing_time'").alias("rejected_missing_time_count"), _n("what = 'error'").alias("error_count"), *(F.coalesce(F.sum(F.col(m).cast("long")), F.lit(0)).alias(m) for m in metrics),
    )
    counts = counts.withColumn("missing_time_count", F.col("candidate_missing_time_count") + F.col("rejected_missing_time_count"))
    out = sources.select(F.col("source_id").cast("string").alias("source_id"), F.coalesce("name", F.col("source_id").cast("string")).alias("name"), "collector").join(counts, "source_id", "left")
    return out.na.fill(0).join(_counts(rows.where("what = 'rejected'"), "v", "reject_reasons"), "source_id", "left")


def selection_reasons() -> Column:
    """Where a source loses candidates, from accepted, theme_pool_selected, document_fetch_selected, story_candidates, final_stories."""
    a, p, f, s, z = (F.col(c) for c in ("accepted_candidates", "theme_pool_selected", "document_fetch_selected", "story_candidates", "final_stories"))
    return fn.reasons(
        ((a > 0) & (p < a), "theme_pool_competition"), ((p > 0) & (f < p), "document_fetch_budget_competition"), ((f > 0) & (s < f), "claim_or_evidence_gate"), ((s > 0) & (z < s), "story_score_competition"),
        (a == 0, "no_accepted_candidates"),
    )


def selection_diagnostics(theme_counts: DataFrame, pool: DataFrame, fetched: DataFrame, story_candidates: DataFrame, finals: DataFrame, packs: DataFrame, document_errors: DataFrame) -> DataFrame:
    """Per source of any input: its counts through the stages, evidence scopes, missing fields, and where it drops out.

    ``theme_counts`` is ``source_theme_counts``; packs have evidence_scope and missing_fields.
    """
    scope = {"v": F.coalesce("evidence_scope", F.lit("unknown"))}
    fields = packs.select("source_id", F.explode("missing_fields").alias("f"))
    rows = _tagged(
        {"pool": (pool, {}), "fetched": (fetched, {}), "story": (story_candidates, {}), "final": (finals, {}), "pack": (packs, scope), "field": (fields, {"v": F.col("f")}), "error": (document_errors, {})}, ["v"]
    )
    n = rows.groupBy("source_id").agg(
        _n("what = 'pool'").alias("theme_pool_selected"), _n("what = 'fetched'").alias("document_fetch_selected"), _n("what = 'error'").alias("document_errors"), _n("what = 'story'").alias("story_candidates"),
        _n("what = 'final'").alias("final_stories"), _n("what = 'pack' and v = 'candidate_url'").alias("own_evidence"), _n("what = 'pack' and v = 'retrieved_context'").alias("retrieved_evidence"),
        _n("what = 'pack' and v = 'none'").alias("no_evidence"), _n("what = 'field' and v = 'time'").alias("missing_time"),
    )
    kept = theme_counts.select("source_id", F.col("raw_candidate_count").alias("raw_candidates"), F.col("main_count").alias("main_candidates"), F.col("supplemental_count").alias("supplemental_candidates"), F.col("accepted_count").alias("accepted_candidates"), F.col("rejected_count").alias("rejected_candidates"))
    out = kept.join(n, "source_id", "full_outer").na.fill(0)
    return out.withColumn("diagnostic_reasons", selection_reasons())


def health_warnings(health: DataFrame) -> DataFrame:
    """One warning per source that is broken or needs fill: (source_id, issue_id, stage, severity, title, message)."""
    broken = F.col("status") == "source_broken"
    title = F.when(broken, F.concat(F.lit("Source broken: "), "source_id")).otherwise(F.concat(F.lit("Source needs fill: "), "source_id"))
    message = F.when(broken, F.format_string("%s is broken after %d errors", "source_id", F.col("error_count").cast("long"))).otherwise(F.format_string("%s gave %d candidates in the window", "source_id", F.col("candidate_count").cast("long")))
    held = health.where(F.col("status").isin("source_broken", "needs_fill"))
    return held.select("source_id", F.lit("RUN-006").alias("issue_id"), F.lit("search_candidates").alias("stage"), F.lit("warning").alias("severity"), title.alias("title"), message.alias("message"), "status")


def fallback_warnings(task_stats: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Task types (task_type, total, success, failure, fallback_used) whose share of failures and fallbacks reaches ``threshold``."""
    problems = F.col("failure") + F.col("fallback_used")
    rate = problems / F.col("total")
    return task_stats.where((F.col("total") > 0) & (rate >= threshold)).select("task_type", "total", problems.alias("problem_count"), F.round(rate, 3).alias("problem_rate"), F.lit("warning").alias("severity"))


def missing_artifacts(present: DataFrame, expected: list[str] = ("content_review.md", "human_review_template.json", "user_notifications.json")) -> DataFrame:
    """(run_id, missing): the expected files that a run of ``present`` (run_id, file_name) does not have; runs with none missing are left out."""
    have = present.groupBy("run_id").agg(F.collect_set(F.when(F.col("file_name").isin(list(expected)), F.col("file_name"))).alias("have"))
    return have.select("run_id", F.array_except(F.array(*(F.lit(e) for e in expected)), "have").alias("missing")).where("size(missing) > 0")


def shadow_task_stats(results: DataFrame) -> DataFrame:
    """Per task_type of (task_type, status): total, success, failure, fallback_used."""
    return results.groupBy("task_type").agg(F.count(F.lit(1)).alias("total"), *(_n(F.col("status") == s).alias(s) for s in ("success", "failure", "fallback_used")))


def status_summary(rows: DataFrame, by: str, statuses: list[str], status: str = "status") -> DataFrame:
    """Per ``by``: total and a count of each status; used for heat observations, relevance labels and probe results."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("total"), *(_n(F.col(status) == s).alias(s) for s in statuses))
