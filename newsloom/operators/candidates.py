"""Candidates: heat, discussion, types, intents, sections, memory, and the core filter and ranking.

A candidate has title, snippet, url, source_id, query, candidate_type: string; tags: array<string>;
heat_signals: map<string,double>; published_at, observed_at: timestamp. Each function adds columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import functions as fn
from newsloom.operators import rules as R


def _tags() -> Column:
    return F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)


def _has_tag(*names: str) -> Column:
    return F.arrays_overlap(_tags(), F.array(*(F.lit(n) for n in names)))


def with_discussion(df: DataFrame, evidence: Column | None = None, only: Column | None = None, name: str = "discussion_profile") -> DataFrame:
    """Adds discussion_profile: engagement, language, platform and tag scores, level and reasons.

    Rows for which ``only`` does not hold have none, and no pattern is tried on them.
    """
    text = fn.join_text(F.col("title"), F.col("snippet"), F.col("query"), F.col("url"), F.col("source_id"), F.array_join("tags", " "), evidence if evidence is not None else F.lit(""))
    signals = F.coalesce("heat_signals", F.create_map().cast("map<string,double>"))
    value = lambda k: F.greatest(F.coalesce(F.try_element_at(signals, F.lit(k)), F.lit(0.0)), F.lit(0.0))
    raw = reduce(lambda a, b: a + b, (value(k) * w for k, w in R.ENGAGEMENT_WEIGHTS.items()))
    direct = reduce(lambda a, b: a | b, (value(k) > 0 for k in R.DIRECT_ENGAGEMENT))
    df = df.withColumn("_text", text if only is None else F.when(only, text)).withColumn("_folded", fn.folded(F.col("_text")))
    found = lambda p: fn.found_in(p, F.col("_text"), F.col("_folded"))
    platforms = fn.reasons(*((found(p), name) for name, p in R.PLATFORM_PATTERNS.items()))
    df = df.withColumns({
        "_raw": raw, "_platforms": platforms, "_direct": direct, "_multi": found(R.GENERIC_MULTI_PLATFORM),
        "_strong": fn.count_true([found(p) for p in R.STRONG_DISCUSSION]), "_weak": fn.count_true([found(p) for p in R.WEAK_DISCUSSION]),
    })
    df = df.withColumn("_multi", F.col("_multi") | (F.size("_platforms") >= 2))
    engagement = F.when(F.col("_raw") > 0, F.least(F.lit(45.0), 8 + F.log1p("_raw") * 7)).otherwise(0.0)
    language = F.when(F.col("_strong") > 0, F.least(F.lit(34.0), 22.0 + F.col("_strong") * 4)).otherwise(0.0) + F.when(F.col("_weak") > 0, 10.0).otherwise(0.0)
    platform = F.when(F.col("_multi"), 30.0).when(F.size("_platforms") == 1, 6.0).otherwise(0.0)
    df = df.withColumns({"_e": engagement, "_l": language, "_p": platform, "_hot": _has_tag("hot_discussion")})
    df = df.withColumn("_score", F.least(F.lit(100.0), F.col("_e") + F.col("_l") + F.col("_p") + F.when(F.col("_hot"), 16.0).otherwise(0.0)))
    level = fn.first_match([(F.col("_score") >= at, name) for at, name in R.DISCUSSION_LEVELS], "none")
    why = fn.reasons(
        *((value(k) > 0, f"engagement:{k}") for k in R.ENGAGEMENT_WEIGHTS),
        (F.col("_multi"), "multi_platform_discussion"), (~F.col("_multi") & (F.size("_platforms") == 1), F.concat(F.lit("platform:"), F.try_element_at("_platforms", F.lit(1)))),
        (F.col("_strong") > 0, "discussion_language:hot_topic"), (F.col("_weak") > 0, "weak_call_to_comment_only"), (F.col("_hot"), "tag:hot_discussion"),
    )
    profile = F.struct(
        F.round("_score", 2).alias("score"), level.alias("level"), F.col("_platforms").alias("platforms"), why.alias("reasons"), F.round("_e", 2).alias("engagement_score"), F.round("_l", 2).alias("discussion_language_score"),
        F.round("_p", 2).alias("platform_diversity_score"), F.col("_direct").alias("has_direct_engagement"), F.col("_multi").alias("has_multi_platform_discussion"),
        ((F.col("_score") >= 35) & (F.col("_direct") | F.col("_multi") | (F.col("_strong") > 0) | F.col("_hot"))).alias("has_discussion_evidence"),
    )
    return df.withColumn(name, profile if only is None else F.when(only, profile)).drop("_text", "_folded", "_raw", "_platforms", "_direct", "_multi", "_strong", "_weak", "_e", "_l", "_p", "_hot", "_score")


def event_time() -> Column:
    return F.coalesce("published_at", "observed_at")


def heat_score(now: Column, lookback_hours: float) -> Column:
    """Heat from source priority and kind, recency, tags and discussion; 100 at most, two decimals."""
    age = F.greatest((F.unix_micros(now) - F.unix_micros(event_time())) / 3.6e9, F.lit(0.0))
    recency = F.greatest(F.lit(0.0), 1 - F.coalesce(age, F.lit(0.0)) / lookback_hours) * R.HEAT["recency"]
    priority = F.least(F.greatest(F.coalesce(F.col("priority").cast("double"), F.lit(50.0)), F.lit(0.0)), F.lit(100.0)) * R.HEAT["priority"]
    tags = reduce(lambda a, b: a + b, (F.when(_has_tag(*names), bonus).otherwise(0.0) for names, bonus in R.TAG_BONUS))
    score = priority + recency + fn.lookup(F.lower(F.coalesce("kind", F.lit(""))), R.KIND_BONUS, 0.0) + tags + F.col("discussion_profile.score") * R.HEAT["discussion"]
    return F.round(F.least(score, F.lit(100.0)), 2)


def heat_reasons() -> Column:
    kind = F.lower(F.coalesce("kind", F.lit("")))
    return fn.reasons(
        (F.lit(True), "source-priority"), (F.lit(True), "freshness"), (kind.isin(*R.KIND_BONUS), F.concat(kind, F.lit("-source"))),
        (_has_tag("meme", "player_story"), "meme/player-story"), (_has_tag("hot_discussion"), "hot-discussion"), (_has_tag("controversy", "price", "dei", "loss"), "controversy-or-market-risk"),
        (F.col("discussion_profile.level") != "none", F.concat(F.lit("discussion:"), F.col("discussion_profile.level"))),
        (F.col("discussion_profile.has_multi_platform_discussion"), "multi-platform-discussion"), (F.col("discussion_profile.has_direct_engagement"), "direct-engagement"),
        (F.col("memory_status") == "follow_up_update", "memory-follow-up-update"),
    )


def memory_key() -> Column:
    """An explicit key, else the URL, else a digest of the title."""
    url = F.regexp_replace(F.lower(fn.clean(F.col("url"))), "/+$", "")
    title = fn.normalized_title(F.col("title"), 0)
    return F.when(url != "", F.concat(F.lit("url:"), url)).when(title != "", fn.short_hash(title, "title:", 16)).otherwise("")


def with_memory_status(df: DataFrame, memory: DataFrame, now: Column, lookback_hours: float) -> DataFrame:
    """Joins the memory (memory_key, first_seen_at) and adds memory_status. The memory side has one row per key."""
    held = memory.select(F.col("memory_key").alias("_key"), F.col("first_seen_at").alias("_first"), F.lit(True).alias("_known"))
    df = df.withColumn("memory_key", F.coalesce("memory_key", memory_key()) if "memory_key" in df.columns else memory_key())
    joined = df.join(held, df["memory_key"] == held["_key"], "left")
    age = (F.unix_micros(now) - F.unix_micros("_first")) / 3.6e9
    update = _has_tag("current_update", "follow_up_update", "new_detail") | (F.coalesce(F.try_element_at("heat_signals", F.lit("current_update")), F.lit(0.0)) != 0)
    status = fn.first_match(
        [(F.col("_known").isNull(), "new_story"), (F.col("_first").isNull(), "known_story_unknown_first_seen"), (age <= lookback_hours, "known_recent_story"), (F.coalesce(update, F.lit(False)), "follow_up_update")], "late_repost"
    )
    return joined.withColumn("memory_status", status).drop("_key", "_first", "_known")


def with_relevance(df: DataFrame, only: Column | None = None) -> DataFrame:
    """Adds relevance_reasons from the source's url and keyword rules (array columns, empty or null for none).

    Rows for which ``only`` does not hold have no reasons, and neither their rules nor their texts are sent to Python.
    """
    from newsloom.functions.python import any_pattern

    none = F.array().cast("array<string>")
    text = fn.join_text(F.col("title"), F.col("snippet"), F.col("url"), F.array_join("tags", " "))
    word = lambda k: F.when(F.startswith(F.lower(k), F.lit("re:")), F.substring(k, 4, 10_000)).when(F.lower(k).rlike("^[a-z0-9]+$"), F.concat(F.lit("(?<![a-z0-9])"), F.lower(k), F.lit("(?![a-z0-9])"))).otherwise(F.concat(F.lit(r"(?:"), F.regexp_replace(F.lower(k), r"([\\.\[\]{}()*+?^$|])", r"\\$1"), F.lit(")")))
    rule = {k: F.coalesce(F.col(k), none) for k in ("allowed_url_patterns", "excluded_url_patterns", "excluded_keywords", "required_any_keywords")}
    url = F.coalesce("url", F.lit(""))
    ruled = lambda k, c: F.when((F.size(rule[k]) > 0) & (F.lit(True) if only is None else only), c)
    hit = lambda k, t, f=None: any_pattern(ruled(k, F.to_json(F.transform(rule[k], f) if f else rule[k])), ruled(k, t))
    why = fn.reasons(
        ((F.size(rule["allowed_url_patterns"]) > 0) & ~hit("allowed_url_patterns", url), "url_not_allowed"), (hit("excluded_url_patterns", url), "url_excluded"),
        (hit("excluded_keywords", text, word), "excluded_keyword"), ((F.size(rule["required_any_keywords"]) > 0) & ~hit("required_any_keywords", text, word), "missing_required_keyword"),
    )
    return df.withColumn("relevance_reasons", why if only is None else F.when(only, why).otherwise(none))


def filter_and_rank(candidates: DataFrame, sources: DataFrame, memory: DataFrame, now: Column, lookback_hours: float = 48) -> DataFrame:
    """All candidates with reject_reason (null: accepted), heat_score and heat_reasons.

    Reject reasons in order: missing_time, outside_time_window (exactly the lookback is inside),
    late_repost_without_current_update, irrelevant_topic. Sources have one row per source_id. Order
    accepted rows by heat_score and event_time, both falling, then by the candidate's ordinal.
    """
    df = with_memory_status(candidates, memory, now, lookback_hours).join(sources, "source_id", "left")
    t = event_time()
    old = (F.unix_micros(t) < F.unix_micros(now) - int(lookback_hours * 3_600_000_000)) | (t > now)
    early = F.coalesce(F.when(t.isNull(), "missing_time"), F.when(old, "outside_time_window"), F.when(F.col("memory_status") == "late_repost", "late_repost_without_current_update"))
    df = with_relevance(df.withColumn("_early", early), F.col("_early").isNull())
    reject = F.coalesce("_early", F.when(F.size("relevance_reasons") > 0, "irrelevant_topic"))
    df = df.withColumn("reject_reason", reject).drop("_early")
    kept = F.col("reject_reason").isNull()
    df = with_discussion(df, only=kept)  # scores need those of accepted rows alone; the others' are added to be read
    df = df.withColumns({"heat_score": F.when(kept, heat_score(now, lookback_hours)), "heat_reasons": F.when(kept, heat_reasons()), "event_time": t})
    df = with_discussion(df, only=~kept, name="_rejected")
    return df.withColumn("discussion_profile", F.coalesce("discussion_profile", "_rejected")).drop("_rejected")


def with_type(df: DataFrame) -> DataFrame:
    """Adds candidate_type, candidate_lane and candidate_type_reasons: the first rule that fits."""
    text = fn.join_text(F.col("title"), F.col("snippet"), F.col("url"), F.array_join("tags", " "))
    df = df.withColumn("_text", text)
    df = df.withColumns({f"_is_{k}": fn.matches(p, F.col("_text")) for k, p in R.TYPE_PATTERNS.items()})
    fits = lambda yes, no: reduce(lambda a, b: a & b, [F.lit(True), *(F.col(f"_is_{k}") for k in yes), *(~F.col(f"_is_{k}") for k in no)])
    chosen = fn.first_match([(fits(yes, no), F.struct(F.lit(t).alias("t"), F.lit(lane).alias("l"), F.array(F.lit(why)).alias("r"))) for t, lane, why, yes, no in R.TYPE_RULES])
    df = df.withColumn("_chosen", chosen).withColumns({"candidate_type": F.col("_chosen.t"), "candidate_lane": F.col("_chosen.l"), "candidate_type_reasons": F.col("_chosen.r")})
    return df.drop("_text", "_chosen", *(f"_is_{k}" for k in R.TYPE_PATTERNS))


def with_intent(df: DataFrame) -> DataFrame:
    """Adds editorial_intent and editorial_priority."""
    text = fn.join_text(F.col("title"), F.col("snippet"), F.col("candidate_type"), F.array_join("tags", " "))
    kind = F.coalesce("candidate_type", F.lit(""))
    intent = fn.first_match(
        [
            (kind.isin(*R.PLATFORM_TYPES) & fn.any_contained(R.PLATFORM_CORE_SIGNALS, text), "core_game_update"), (kind.isin(*R.PLATFORM_TYPES), "platform_business"),
            (kind.isin(*R.CORE_TYPES) | fn.any_contained(R.CORE_SIGNALS, text), "core_game_update"), (fn.any_contained(R.SENTIMENT_SIGNALS, text), "personal_or_sentiment"), (kind.isin("rumor", "news"), "core_game_report"),
        ],
        "general",
    )
    df = df.withColumn("editorial_intent", intent)
    return df.withColumn("editorial_priority", fn.lookup(F.col("editorial_intent"), R.INTENT_PRIORITY, 1).cast("int"))


def with_section(df: DataFrame) -> DataFrame:
    """Adds theme_section: the title's first section, else the only section of all the text, else supplemental."""
    title = F.lower(F.coalesce("title", F.lit("")))
    text = fn.join_text(F.col("title"), F.col("snippet"), F.col("url"), F.col("source_id"), F.col("candidate_type"), F.col("query"), F.array_join("tags", " "))
    found = fn.reasons(*((fn.any_contained(words, text), s) for s, words in R.SECTIONS.items()))
    by_title = F.coalesce(*(F.when(fn.any_contained(words, title), s) for s, words in R.SECTIONS.items()))
    return df.withColumn("theme_section", F.coalesce(by_title, F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1))), F.lit(R.SUPPLEMENTAL)))


def merge_duplicates(df: DataFrame, key: Column, ordinal: str = "ordinal") -> DataFrame:
    """One row per key (empty keys all stay): the first row's fields, the union of tags in order of appearance."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    keyed = df.withColumn("_key", F.when(key == "", F.concat(F.lit("row:"), F.col(ordinal).cast("string"))).otherwise(F.concat(F.lit("key:"), key)))
    merged = keyed.groupBy("_key").agg(F.min_by(whole, F.col(ordinal)).alias("first"), F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), "tags"))).alias("all"), F.count(F.lit(1)).alias("duplicate_count"))
    tags = F.array_distinct(F.flatten(F.transform("all", lambda x: F.coalesce(x["tags"], F.array().cast("array<string>")))))
    return merged.select("first.*", "duplicate_count", tags.alias("_tags")).withColumn("tags", F.col("_tags")).drop("_tags")
