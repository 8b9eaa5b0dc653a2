"""Audits: dominance, theme counts, health, funnels, quality score, contracts, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import functions as fn

# Stage weights and gates of the quality score.
STAGE_WEIGHTS = {"collection": 0.15, "filtering": 0.15, "evidence": 0.20, "verification": 0.25, "selection": 0.15, "packaging": 0.10}
PASS, REVIEW = 85, 60
BLOCKED_CODES = (401, 403, 407, 408, 429)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 4)).otherwise(F.lit(0.0))


def dominance(stats: DataFrame, source: str) -> DataFrame:
    """Shares, ratios and reasons per source from candidate_count, document_count, title_heat, engaged, noise."""
    n, d = F.col("candidate_count"), F.col("document_count")
    # one row of totals; the top source is that of most candidates, the first by its id among equals
    totals = stats.agg(F.sum(n).alias("_total"), F.max(d).alias("_most"), F.min_by(F.col(source), F.struct(-n, F.col(source))).alias("_top"))
    df = stats.crossJoin(F.broadcast(totals))
    df = df.withColumn("candidate_share", ratio(n, F.col("_total")))
    why = fn.reasons(
        ((F.col(source) == F.col("_top")) & (F.col("candidate_share") >= 0.5), "volume_advantage"), ((d > 0) & (d == F.col("_most")), "fetch_advantage"), (F.col("title_heat") > 0, "language_advantage"),
        (F.col("engaged") > 0, "real_engagement_advantage"), ((F.col("engaged") <= 0) & (F.col("title_heat") > 0), "false_heat_advantage"), (F.col("noise") > 0, "noise_advantage"),
    )
    out = df.withColumns({"document_coverage": ratio(d, n), "noise_ratio": ratio(F.col("noise"), n), "dominant": F.col(source) == F.col("_top"), "reasons": why})
    return out.drop("_total", "_most", "_top")


def health(sources: DataFrame, source: str) -> DataFrame:
    """Adds status from accepted, rejected, fetched, errors, blocked (counts): healthy at three accepted or more."""
    status = fn.first_match(
        [(F.col("accepted") >= 3, "healthy"), (F.col("blocked") > 0, "source_blocked"), ((F.col("errors") > 0) | (F.col("fetched") == 0), "source_broken"), ((F.col("accepted") > 0) | (F.col("rejected") > 0), "needs_fill")], "source_broken"
    )
    return sources.withColumn("status", status)


def bottleneck() -> Column:
    """The first stage of the funnel that loses items."""
    steps = [
        ("pool_count", "fetch_selected_count", "document_fetch_budget"), ("fetch_selected_count", "context_pack_count", "document_fetch_failure"), ("context_pack_count", "claim_verification_count", "claim_extraction_or_verification"),
        ("claim_verification_count", "story_candidate_count", "story_publishability_filter"), ("story_candidate_count", "final_selected_count", "final_ranking_limit"), ("source_accepted_count", "candidate_count", "candidate_pool_classification"),
    ]
    return fn.first_match([(F.col(a) > F.col(b), why) for a, b, why in steps], "no_drop_detected")


def overall_quality(scores: dict[str, Column]) -> Column:
    """Weighted stage scores, rounded half to even as whole points."""
    total = sum((scores[k] * w for k, w in STAGE_WEIGHTS.items()), F.lit(0.0))
    return F.bround(total, 0).cast("int")


def readiness(score: Column) -> Column:
    return fn.first_match([(score >= PASS, "pass"), (score >= REVIEW, "needs_review")], "fail")


def contract_errors(df: DataFrame, id_col: str, required: list[str], any_of: list[list[str]] = ()) -> DataFrame:
    """(id, error) rows: required fields that are null or blank, groups of which no field is there."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    every = [(blank(c), f"missing:{c}") for c in required]
    for group in any_of:
        none = blank(group[0])
        for c in group[1:]:
            none = none & blank(c)
        every.append((none, f"missing_any:{'|'.join(group)}"))
    return df.select(id_col, F.explode(fn.reasons(*every)).alias("error"))


def recovery_actions(target: int = 10) -> Column:
    """Actions a source needs, from errors, count, missing_time, irrelevant (counts)."""
    return fn.reasons(
        (F.col("errors") > 0, "inspect_errors"), (F.col("count") < target, "raise_volume"), (F.col("missing_time") > 0.3 * F.greatest("count", F.lit(1)), "backfill_times"),
        (F.col("irrelevant") >= F.greatest(3 * F.col("count"), F.lit(1)), "tighten_entry_points"),
    )
