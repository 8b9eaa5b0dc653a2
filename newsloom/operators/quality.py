"""The content-quality report: metrics of a run's tables, six stage scores by weighted criteria, issues and the gate.

Each metric is an aggregation over its own table, so a run of any size becomes one row; criteria,
stages and issues are expressions on that row, exploded into rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import functions as fn
from newsloom.operators.audit import PASS, REVIEW, ratio

# Weights of the stages, statuses of rumors, and who counts as healthy.
WEIGHTS = {"source_collection": 0.15, "candidate_filtering": 0.15, "evidence_fetch": 0.20, "claim_verification": 0.25, "story_selection": 0.15, "platform_packaging": 0.10}
RUMORS = ["credible_rumor", "weak_rumor", "unverified_rumor", "rumor"]
HEALTH = ["healthy", "needs_fill", "source_blocked", "source_broken"]
COUNTS = ("candidates", "supplemental", "rejected", "documents", "verifications", "stories", "posts", "llm_requests", "llm_results")


def clamp(x: Column) -> Column:
    """A whole score from 0 to 100, halves to the even number."""
    return F.least(F.greatest(F.bround(x.cast("double"), 0).cast("int"), F.lit(0)), F.lit(100))


def dominant_share(df: DataFrame, by: Column, name: str) -> DataFrame:
    """One row: the share of the most frequent value, null and blank counted as unknown; 0 of an empty table."""
    each = df.groupBy(F.coalesce(F.nullif(fn.clean(by.cast("string")), F.lit("")), F.lit("unknown")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.coalesce(ratio(F.max("n"), F.sum("n")), F.lit(0.0)).alias(name))


def url_domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(fn.url_host(url)), r"^www\.", "")


def metrics(tables: dict[str, DataFrame], pool_fetched: int = 0, pool_selected: int = 0) -> DataFrame:
    """One row of a run's metrics. Tables that are absent count as empty.

    candidates (source_id, has_heat, has_discussion), supplemental, rejected, documents, verifications,
    stories (source_urls, has_rumor), posts (has_rumor, asset_status), llm_requests, llm_results and health
    (status). Document coverage is of the candidates chosen for fetching, else for the pool, else of all.
    """
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    rows = []
    for name in COUNTS:
        if name in tables:
            more = {"candidates": ["has_heat", "has_discussion"], "stories": ["has_rumor"], "posts": ["has_rumor"]}.get(name, [])
            aggs = [n(F.col(c), f"{name}_{c}") for c in more] + ([n(F.col("asset_status") == "manual_fill_required", "manual_assets")] if name == "posts" else [])
            rows.append(tables[name].agg(F.count(F.lit(1)).alias(name), *aggs))
    if "health" in tables:
        rows.append(tables["health"].agg(*(n(F.col("status") == s, s) for s in HEALTH)))
    if "candidates" in tables:
        rows.append(dominant_share(tables["candidates"], F.col("source_id"), "candidate_share"))
    if "stories" in tables:
        rows.append(dominant_share(tables["stories"], url_domain(F.try_element_at("source_urls", F.lit(1))), "story_share"))
    one = reduce(lambda a, b: a.crossJoin(b), rows)  # one row each
    zero = [*COUNTS, *HEALTH, "candidates_has_heat", "candidates_has_discussion", "stories_has_rumor", "posts_has_rumor", "manual_assets"]
    one = one.withColumns({c: F.lit(0).cast("long") for c in zero if c not in one.columns} | {c: F.lit(0.0) for c in ("candidate_share", "story_share") if c not in one.columns})
    whole = F.lit(pool_fetched or pool_selected).cast("long") if pool_fetched or pool_selected else F.col("candidates")
    return one.withColumns({
        "heat_signal_coverage": ratio(F.col("candidates_has_heat"), F.col("candidates")), "discussion_signal_coverage": ratio(F.col("candidates_has_discussion"), F.col("candidates")),
        "document_fetch_coverage": ratio(F.col("documents"), whole), "story_to_candidate_ratio": ratio(F.col("stories"), F.col("candidates")), "manual_asset_ratio": ratio(F.col("manual_assets"), F.col("posts")),
    })


def _criteria() -> Column:
    """An array of (stage, criterion, score, weight); a stage that has nothing to score has criteria of 0."""
    c = F.col
    one = lambda name, score, weight: F.struct(F.lit(name).alias("criterion"), clamp(score if isinstance(score, Column) else F.lit(float(score))).alias("score"), F.lit(weight).alias("weight"))
    stage = lambda name, *cases: F.transform(fn.first_match([(cond, F.array(*items)) for cond, items in cases]), lambda x: F.struct(F.lit(name).alias("stage"), x["criterion"].alias("criterion"), x["score"].alias("score"), x["weight"].alias("weight")))
    sources = c("healthy") + c("needs_fill") + c("source_blocked") + c("source_broken")
    share = lambda x: F.when(sources > 0, x / sources).otherwise(0.0)
    rumors = (c("stories_has_rumor") > 0) | (c("posts_has_rumor") > 0)
    covered = F.when(c("llm_requests") > 0, c("llm_results") / c("llm_requests")).otherwise(1.0)
    always = F.lit(True)
    return F.concat(
        stage(
            "source_collection",
            (sources > 0, [one("healthy_source_ratio", share(c("healthy")) * 100, 0.7), one("blocked_source_penalty", (1 - share(c("source_blocked") + c("source_broken"))) * 100, 0.2), one("manual_fill_penalty", (1 - share(c("needs_fill"))) * 100, 0.1)]),
            (c("candidates") > 0, [one("healthy_source_ratio", 60, 1.0)]),
            (always, [one("healthy_source_ratio", 0, 1.0)]),
        ),
        stage(
            "candidate_filtering",
            (c("candidates") == 0, [one("candidate_volume", 0, 0.5), one("source_diversity", 0, 0.3), one("lane_separation", 0, 0.2)]),
            (always, [one("candidate_volume", F.least(F.lit(100), c("candidates") * 10), 0.25), one("source_diversity", (1 - c("candidate_share")) * 100, 0.35), one("lane_separation", F.when((c("supplemental") > 0) | (c("rejected") > 0), 100).otherwise(60), 0.2), one("discussion_signal_support", c("discussion_signal_coverage") * 100, 0.2)]),
        ),
        stage("evidence_fetch", (always, [one("document_coverage", c("document_fetch_coverage") * 100, 0.65), one("minimum_evidence_depth", F.least(F.lit(100), c("documents") * 12), 0.35)])),
        stage(
            "claim_verification",
            (c("verifications") == 0, [one("rule_verification_coverage", 0, 0.45), one("llm_or_manual_coverage", 0, 0.4), one("rumor_safety", 0, 0.15)]),
            (always, [one("rule_verification_coverage", 100, 0.35), one("llm_or_manual_coverage", covered * 100, 0.45), one("rumor_safety", F.when(rumors & (c("llm_results") == 0), 0).otherwise(100), 0.2)]),
        ),
        stage(
            "story_selection",
            (c("stories") == 0, [one("story_volume", 0, 0.45), one("story_source_diversity", 0, 0.4), one("briefing_focus", 0, 0.15)]),
            (always, [one("story_volume", F.least(F.lit(100), c("stories") * 25), 0.35), one("story_source_diversity", (1 - c("story_share")) * 100, 0.45), one("briefing_focus", F.when(c("stories") <= 8, 80).otherwise(60), 0.2)]),
        ),
        stage(
            "platform_packaging",
            ((c("stories") > 0) & (c("posts") == 0), [one("copy_coverage", 0, 0.55), one("asset_readiness", 0, 0.3), one("reviewability", 0, 0.15)]),
            (c("posts") == 0, [one("copy_coverage", 50, 1.0)]),
            (always, [one("copy_coverage", F.least(F.lit(1.0), c("posts") / F.greatest(c("stories"), F.lit(1))) * 100, 0.45), one("asset_readiness", (1 - c("manual_asset_ratio")) * 100, 0.35), one("reviewability", 85, 0.2)]),
        ),
    )


def stage_scores(metrics_: DataFrame, pass_at: int = PASS, review_at: int = REVIEW) -> DataFrame:
    """(stage, score, status, criteria): each stage's weighted score, pass, needs_review or blocked, and its criteria by name."""
    rows = metrics_.select("documents", F.explode(_criteria()).alias("x")).select("documents", "x.*")
    score = clamp(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"))
    out = rows.groupBy("stage").agg(score.alias("score"), F.max("documents").alias("documents"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("criterion", "score")))).alias("criteria"))
    enough = (F.col("stage") == "evidence_fetch") & (F.col("documents") >= 5)
    out = out.withColumn("score", F.when(enough, F.greatest("score", F.lit(60))).otherwise(F.col("score")))
    return out.select("stage", "score", F.when(F.col("score") >= pass_at, "pass").when(F.col("score") >= review_at, "needs_review").otherwise("blocked").alias("status"), "criteria")


def issues(metrics_: DataFrame) -> DataFrame:
    """(issue_no, code, severity): what speaks against the run's content, in order."""
    c, none = F.col, F.col("llm_results") == 0
    rumors = (c("stories_has_rumor") > 0) | (c("posts_has_rumor") > 0)
    found = [
        ("source_collection_blocked", (c("healthy") == 0) & (c("source_blocked") + c("source_broken") > 0)),
        ("no_main_candidates", c("candidates") == 0),
        ("low_discussion_signal_coverage", (c("candidates") >= 4) & (c("discussion_signal_coverage") < 0.4)),
        ("single_source_story_dominance", (c("stories") >= 3) & (c("story_share") >= 0.67)),
        ("no_llm_verification_results", (c("llm_requests") > 0) & none),
        ("rumor_without_llm_verification", rumors & none),
        ("limited_document_fetch", (c("candidates") > 0) & (c("documents") < F.least(c("candidates"), F.lit(5)))),
        ("missing_platform_posts", (c("stories") > 0) & (c("posts") == 0)),
        ("manual_assets_required", (c("posts") > 0) & (c("manual_assets") == c("posts"))),
    ]
    rows = F.array_compact(F.array(*(F.when(cond, F.struct(F.lit(i).alias("issue_no"), F.lit(code).alias("code"), F.lit("error" if i == 0 else "warning").alias("severity"))) for i, (code, cond) in enumerate(found))))
    return metrics_.select(F.explode(rows).alias("i")).select("i.*")


def report(metrics_: DataFrame, pass_at: int = PASS, review_at: int = REVIEW) -> DataFrame:
    """One row: gate_status, overall_score, readiness, issues (codes in order) and each stage's score."""
    scores = stage_scores(metrics_, pass_at, review_at)
    weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))
    # Weighted in the order of the stages, so that sums of halves round alike on any cluster.
    by_stage = [F.max(F.when(F.col("stage") == s, F.col("score"))).alias(s) for s in WEIGHTS]
    total = scores.agg(*by_stage)
    overall = clamp(reduce(lambda a, b: a + b, (F.col(s) * weight[F.lit(s)] for s in WEIGHTS)))
    against = issues(metrics_).agg(F.transform(F.array_sort(F.collect_list(F.struct("issue_no", "code"))), lambda x: x["code"]).alias("issues"), F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).alias("_error"))
    one = total.withColumn("overall_score", overall).crossJoin(against)  # one row each
    gate = F.when(F.col("_error"), "blocked").when(F.size("issues") > 0, "needs_review").otherwise("pass")
    ready = F.when(gate == "blocked", "blocked").when((F.size("issues") == 0) & (F.col("overall_score") >= pass_at), "ready_for_layout").otherwise("ready_for_content_review")
    return one.select(gate.alias("gate_status"), "overall_score", ready.alias("readiness"), "issues", *WEIGHTS)
