"""Discussion probes, heat observations, editorial review requests, source recovery: requests, reports and what they change.

Candidates have candidate_id, title, snippet, query, url, source_id, language, candidate_type,
candidate_lane, theme_section, discussion_score and, where probes are applied, discussion_profile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import functions as fn
from newsloom.operators import social
from newsloom.operators.selection import top_per_group

# Text that stands on pages of sites and is no evidence.
BOILERPLATE = r"stay ahead with pc gamer|become a member|newsletter|privacy policy|terms & conditions|latest hardware news|straight to your inbox|you are now subscribed"
# Types that need a review, types that are safe, and names that are often off topic.
AMBIGUOUS_TYPES = ["manual_review", "supplemental_context", "pc_hardware_or_event", "general_tech", "off_topic_entertainment", "meme_gallery", "discussion_search_lead"]
SAFE_TYPES = ["news", "rumor", "platform_price", "hardware_platform", "review_score"]
OFF_TOPIC = r"比尔盖茨|爱泼斯坦|黄仁勋|梅西|滨崎步|易梦玲|鹅腿阿姨|胖东来|于东来|\bbill gates\b|\bepstein\b|\bnvidia ceo\b"
# Candidates expected of a collector, and thresholds of recovery issues.
EXPECTED = {"media_incremental_listing": 10, "media_listing": 10, "media_jsonp_paged_listing": 10, "media_rss": 5, "media_embedly_listing": 8, "official_rss": 3}
EXPECTED_DEFAULT = 8
MISSING_TIME, ERRORS, LINK_RATIO, DUPLICATES = 0.3, 2, 0.1, 0.5
# Weights of a source's need of navigation.
NAVIGATION = {"error_count": 20.0, "parse_warning_count": 8.0, "missing_time_count": 4.0, "rejected_missing_time_count": 4.0, "duplicate_url_count": 1.0}
NAVIGATION_REJECTS = {"missing_time": 3.0, "irrelevant_topic": 5.0, "outside_time_window": 0.5}


def is_boilerplate(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike(BOILERPLATE)


def probe_query(title: Column, max_chars: int = 96) -> Column:
    """A title as a search query: white space collapsed, the site's name cut off, ``max_chars`` at most."""
    t = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "))
    return F.trim(F.substring(F.regexp_replace(t, r"(?i)\s*[|_-]\s*(IGN|GameSpot|PC Gamer).*$", ""), 1, max_chars))


def fallback_query(title: Column, entities: Column) -> Column:
    """The first game with the first platform or event, else the title as it is, shortened."""
    game, side = F.try_element_at(entities["games"], F.lit(1)), F.coalesce(F.try_element_at(entities["platforms"], F.lit(1)), F.try_element_at(entities["events"], F.lit(1)))
    plain = F.trim(F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"https?://\S+|[\[\](){}【】]", " "), r"\s+", " ")), 1, 96))
    return F.when(game.isNotNull(), F.concat_ws(" ", F.concat(F.lit("《"), game, F.lit("》")), side)).otherwise(plain)


def probe_requests(candidates: DataFrame, ordinal: str, limit: int = 20) -> DataFrame:
    """(request_no, candidate_url, query, heat_region): the first ``limit`` candidates with a URL or title and a query, each key once."""
    key = F.coalesce(F.nullif(fn.clean(F.col("url")), F.lit("")), F.nullif(fn.clean(F.col("title")), F.lit("")))
    named = F.coalesce(F.nullif(fn.clean(F.col("title")), F.lit("")), F.nullif(fn.clean(F.col("query")), F.lit("")), key)
    rows = candidates.select(F.col(ordinal).alias("o"), key.alias("key"), F.col("url").alias("candidate_url"), probe_query(named).alias("query"), social.heat_region(F.col("language"), F.col("source_id"), F.col("url")).alias("heat_region")).where("key is not null")
    first = rows.groupBy("key").agg(F.min_by(F.struct("o", "candidate_url", "query", "heat_region"), "o").alias("r")).select("r.*").where("query <> ''")
    ranked = top_per_group(first.withColumn("_all", F.lit(1)), "_all", [F.col("o")], limit, "request_no")
    return ranked.select("request_no", "candidate_url", "query", "heat_region")


def evidence_texts(packs: DataFrame) -> DataFrame:
    """(url, texts): the quotes of each pack's evidence that are no boilerplate, of one pack per URL (the last by candidate_id)."""
    quotes = F.filter(F.transform("evidence", lambda e: F.trim(F.coalesce(e["quote"], F.lit("")))), lambda q: (q != "") & ~is_boilerplate(q))
    rows = packs.where(fn.clean(F.col("url")) != "").select(fn.clean(F.col("url")).alias("url"), "candidate_id", quotes.alias("texts"))
    return rows.groupBy("url").agg(F.max_by("texts", "candidate_id").alias("texts"))


def stronger_profile(a: Column, b: Column) -> Column:
    """The profile with evidence of discussion if only one has it, else that of the larger score, the first among equals."""
    proof = lambda p: F.coalesce(p["has_discussion_evidence"], F.lit(False)).cast("int")
    score = lambda p: F.coalesce(p["score"], F.lit(0.0))
    return F.when((proof(b) > proof(a)) | ((proof(b) == proof(a)) & (score(b) > score(a))), b).otherwise(a)


def promotable(profile: Column) -> Column:
    return F.coalesce(profile["has_discussion_evidence"], F.lit(False)) | (profile["level"].isin("discussed", "trending") & (profile["score"] >= 35.0))


def apply_probes(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """Candidates with discussion_score, discussion_level and discussion_probe_status: null without a probe, else promoted or kept_existing.

    Results have candidate_url, probe_no (the last of a URL holds) and discussion_profile; a probe's
    profile takes the place of a candidate's if it can be promoted and has the larger score.
    """
    last = results.where(fn.clean(F.col("candidate_url")) != "").groupBy(fn.clean(F.col("candidate_url")).alias("_url")).agg(F.max_by("discussion_profile", "probe_no").alias("_probe"))
    joined = candidates.join(last, fn.clean(F.col("url")) == F.col("_url"), "left")
    better = promotable(F.col("_probe")) & (F.coalesce(F.col("_probe.score"), F.lit(0.0)) > F.coalesce(F.col("discussion_profile.score"), F.lit(0.0)))
    better = F.coalesce(better, F.lit(False))
    return joined.withColumns({
        "discussion_probe_status": F.when(F.col("_url").isNull(), None).when(better, "promoted").otherwise("kept_existing"),
        "discussion_score": F.when(better, F.col("_probe.score")).otherwise(F.col("discussion_score")),
        "discussion_level": F.when(better, F.col("_probe.level")).otherwise(F.col("discussion_level")),
    }).drop("_url", "_probe")


def probe_report(results: DataFrame) -> DataFrame:
    """One row: probed_candidates, with_discussion_evidence, coverage."""
    n = F.count(F.lit(1))
    with_ = F.sum(F.when(F.coalesce(F.col("discussion_profile.has_discussion_evidence"), F.lit(False)), 1).otherwise(0))
    return results.agg(n.alias("probed_candidates"), F.coalesce(with_, F.lit(0)).alias("with_discussion_evidence"), F.coalesce(F.round(with_ / F.nullif(n, F.lit(0)), 4), F.lit(0.0)).alias("coverage"))


def relevance_summary(checks: DataFrame) -> DataFrame:
    """(kind, value, n): how often each deterministic_status, time_hint_status and result_type occurs, and what needs a semantic review."""
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    pairs = F.array(
        pair("status", F.coalesce("deterministic_status", F.lit("unknown"))),
        pair("time_hint", F.coalesce("time_hint_status", F.lit("unknown_time"))),
        pair("result_type", F.coalesce("result_type", F.lit("unknown"))),
        pair("semantic_review", F.coalesce(F.col("requires_semantic_review"), F.lit(False)).cast("string")),
    )
    rows = checks.select(F.explode(pairs).alias("r"))
    return rows.groupBy("r.kind", "r.value").agg(F.count(F.lit(1)).alias("n"))


def semantic_requests(checks: DataFrame, ordinal: str, limit: int = 20) -> DataFrame:
    """The first ``limit`` checks that need a semantic review, with request_id semantic_relevance_1 and so on."""
    held = checks.where(F.col("requires_semantic_review")).withColumn("_all", F.lit(1))
    ranked = top_per_group(held, "_all", [F.col(ordinal)], limit, "request_no")
    return ranked.withColumn("request_id", F.concat(F.lit("semantic_relevance_"), "request_no")).drop("_all")


def judgment_reasons(force_all: bool = False) -> Column:
    """Why an editor should look at a candidate; empty if nothing speaks for it."""
    kind = F.coalesce("candidate_type", F.lit(""))
    text = fn.join_text(F.col("title"), F.col("snippet"), F.col("url"))
    return fn.reasons(
        (F.lit(force_all), "forced_review"), (kind.isin(AMBIGUOUS_TYPES), F.concat(F.lit("ambiguous_candidate_type:"), kind)), (fn.matches(f"({OFF_TOPIC})", text), "off_topic_risk"),
        (F.coalesce("candidate_lane", F.lit("")) == "supplemental", "supplemental_lane"), ((F.coalesce("discussion_score", F.lit(0.0)) >= 25) & ~kind.isin(SAFE_TYPES), "social_heat_needs_game_relevance_check"),
    )


def judgment_requests(candidates: DataFrame, ordinal: str, limit: int = 20, force_all: bool = False) -> DataFrame:
    """(request_id, ordinal, request_no, reasons) of the first ``limit`` candidates with a reason, one for each URL, or title where there is none.

    ``ordinal`` is a candidate's place in the input, from 0; the id is a digest of URL, title and place.
    """
    held = candidates.withColumn("reasons", judgment_reasons(force_all)).where("size(reasons) > 0")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    once = held.groupBy(F.when(text("url") != "", text("url")).otherwise(text("title")).alias("_key")).agg(F.min(F.struct(F.col(ordinal), text("url").alias("url"), text("title").alias("title"), "reasons")).alias("c"))
    ranked = top_per_group(once.select("c.*", F.lit(1).alias("_all")), "_all", [F.col(ordinal)], limit, "request_no")
    raw = F.concat_ws("|", "url", "title", F.col(ordinal).cast("string"))
    return ranked.select(fn.short_hash(raw, "editorial_judgment_", 10).alias("request_id"), ordinal, "request_no", "reasons")


def recovery_issues(diagnostics: DataFrame) -> DataFrame:
    """(source_id, issue_type, why): what is wrong with a source, from collector diagnostics with health_status and health_errors.

    Needs candidate_count, raw_fetch_count, error_count, link_count, missing_time_count,
    duplicate_url_count, irrelevant_rejects, missing_time_rejects, collector.
    """
    n, links = F.col("candidate_count"), F.col("link_count")
    errors = F.greatest("error_count", "health_errors")
    least = fn.lookup(F.lower(fn.clean(F.col("collector"))), EXPECTED, EXPECTED_DEFAULT)
    timed = F.greatest(n + F.col("missing_time_rejects"), F.lit(1))
    issue = lambda kind, why: F.struct(F.lit(kind).alias("issue_type"), F.lit(why).alias("why"))
    rules = [
        ((errors >= ERRORS) & (n == 0), issue("entry_broken", "errors_without_candidates")), (F.col("health_status") == "source_blocked", issue("network_persistent", "source_blocked")),
        ((n > 0) & (n < least), issue("low_count", "below_expected")), ((n == 0) & (errors < ERRORS) & (F.col("raw_fetch_count") > 0), issue("low_count", "no_candidates")),
        ((links > 0) & (n > 0) & (n / links < LINK_RATIO), issue("structure_change", "few_links_accepted")), (F.col("irrelevant_rejects") >= F.greatest(n * 3, F.lit(10)), issue("structure_change", "irrelevant_rejects")),
        (F.col("missing_time_count") / timed >= MISSING_TIME, issue("missing_timestamps", "missing_time_ratio")), ((n > 0) & (F.col("duplicate_url_count") / n >= DUPLICATES), issue("structure_change", "duplicate_urls")),
    ]
    found = F.array_compact(F.array(*(F.when(c, v) for c, v in rules)))
    return diagnostics.select("source_id", F.explode(found).alias("i")).select("source_id", "i.issue_type", "i.why")


def navigation_need() -> Column:
    """How much a source needs a look at its navigation, from its diagnostics and map reject_reasons."""
    n = F.col("candidate_count")
    score = F.when(n == 0, 80.0).when(n < 5, 30.0).when(n < 10, 10.0).otherwise(0.0)
    for c, w in NAVIGATION.items():
        score = score + F.coalesce(F.col(c), F.lit(0)) * w
    for reason, w in NAVIGATION_REJECTS.items():
        score = score + F.coalesce(F.try_element_at("reject_reasons", F.lit(reason)), F.lit(0)) * w
    return F.round(score, 2)


def navigation_requests(diagnostics: DataFrame, limit: int = 5) -> DataFrame:
    """The ``limit`` sources that need navigation most, with need_score and rank."""
    held = diagnostics.withColumn("need_score", navigation_need()).where("need_score > 0").withColumn("_all", F.lit(1))
    return top_per_group(held, "_all", [F.desc("need_score"), F.col("source_id")], limit).drop("_all")
