"""Review of clusters that share an entity: pairs, roles and votes; parsing of model verdicts; history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import functions as fn

# Words of commentary and of details, patterns of official sources.
COMMENTARY = ["评论", "热议", "玩家反应", "吐槽", "整活", "梗", "恶搞", "二创", "网友", "社区", "分析", "评测", "测评", "观点", "看法", "为什么", "reaction", "commentary", "opinion", "editorial", "analysis", "review", "impressions", "hands-on", "take", "hot take"]
DETAIL = ["新角色", "新预告", "发售日", "发售日期", "定档", "售价", "价格", "预购", "预载", "试玩", "demo", "dlc", "更新", "patch", "补丁", "系统要求", "配置", "画面对比", "实机演示", "gameplay", "trailer", "release date", "price", "preorder", "preload", "system requirements", "new character", "new trailer", "update"]
OFFICIAL = r"\bnintendo\b|\bplaystation\b|\bxbox\b|\bsteampowered\b|\bepicgames\b|\bsquare-enix\b|\bubisoft\b|\bea\.com\b|\bbethesda\b|\bcapcom\b|\bsega\b|\bbandainamco\b|\bactivision\b|\bblizzard\b|\briotgames\b|\brockstargames\b|\bfromsoftware\b|任天堂|索尼|微软"
VERDICTS = ["verified", "likely", "credible_rumor", "weak_rumor", "rumor", "reject"]


def review_requests(clusters: DataFrame) -> DataFrame:
    """(entity, clusters) of entities that two clusters or more name. Clusters have cluster_id, entities."""
    named = clusters.select("cluster_id", F.explode(F.array_distinct("entities")).alias("entity"))
    return named.groupBy("entity").agg(F.sort_array(F.collect_set("cluster_id")).alias("clusters")).where("size(clusters) >= 2")


def cluster_roles(clusters: DataFrame) -> DataFrame:
    """(entity, a, b, role, confidence) for the pairs of clusters of one entity.

    Clusters have cluster_id, title, urls, entities, first_time. An entity's clusters are few (a
    review request); pairs come from an equi-join on the entity.
    """
    one = clusters.select("cluster_id", "title", "urls", "entities", "first_time", F.explode(F.array_distinct("entities")).alias("entity"))
    side = lambda s: one.select("entity", *(F.col(c).alias(f"{c}_{s}") for c in ("cluster_id", "title", "urls", "entities", "first_time")))
    p = side("a").join(side("b"), "entity").where("cluster_id_a < cluster_id_b")
    urls = lambda s: F.filter(F.transform(f"urls_{s}", fn.canonical_url), lambda u: u != "")
    toks = lambda s: F.array_distinct(fn.tokens(F.coalesce(f"title_{s}", F.lit(""))))
    has = lambda words: fn.any_contained(words, F.lower(F.concat_ws(" ", "title_a", "title_b")))
    official = lambda s: fn.matches(OFFICIAL, F.array_join(f"urls_{s}", " "))
    hosts = lambda s: F.array_distinct(F.transform(urls(s), fn.url_host))
    p = p.withColumns({"_j": fn.jaccard(toks("a"), toks("b")), "_same": F.arrays_overlap(urls("a"), urls("b")), "_oa": official("a"), "_ob": official("b"), "_h": F.abs(F.unix_micros("first_time_a") - F.unix_micros("first_time_b")) / 3.6e9})
    p = p.withColumn("_div", F.when((F.size(hosts("a")) == 0) | (F.size(hosts("b")) == 0), 0.5).otherwise(1 - fn.jaccard(hosts("a"), hosts("b"))))
    row = lambda role, conf: F.struct(F.lit(role).alias("role"), F.round(conf, 2).alias("confidence"))
    detail = F.least(F.when(F.coalesce(F.col("_h") < 72, F.lit(False)), 0.76).otherwise(0.70) + F.when(F.col("_div") > 0.5, 0.05).otherwise(0.0), F.lit(0.90))
    r = (
        F.when(F.col("_same"), row("duplicate_report", F.lit(0.95)))
        .when(F.col("_j") > 0.8, row("duplicate_report", F.least(F.greatest(F.lit(0.82), F.least(F.lit(0.95), F.col("_j"))) + 0.03, F.lit(0.97))))
        .when(F.col("_oa") | F.col("_ob"), row("official_confirmation", F.when(F.col("_oa") & F.col("_ob"), 0.88).otherwise(0.82)))
        .when((F.col("_j") < 0.4) & has(COMMENTARY), row("reaction_or_commentary", F.lit(0.68)))
        .when(F.col("_j").between(0.15, 0.8) & has(DETAIL), row("new_detail_after_announcement", detail))
        .otherwise(row("unrelated", F.lit(0.55)))
    )
    return p.withColumn("_r", r).select("entity", F.col("cluster_id_a").alias("a"), F.col("cluster_id_b").alias("b"), F.col("_r.role").alias("role"), F.col("_r.confidence").alias("confidence"))


def votes(roles: DataFrame) -> DataFrame:
    """(entity, role, votes, confidence): the role most pairs have, by confidence among equals."""
    n = roles.groupBy("entity", "role").agg(F.count(F.lit(1)).alias("votes"), F.sum("confidence").alias("total"))
    best = n.groupBy("entity").agg(F.max(F.struct("votes", "total", "role")).alias("m"))
    return best.select("entity", F.col("m.role").alias("role"), F.col("m.votes").alias("votes"), F.round(F.col("m.total") / F.col("m.votes"), 2).alias("confidence"))


def parsed_verdicts(df: DataFrame, response: str) -> DataFrame:
    """Adds parse_status, check_status, confidence of model answers in JSON: invalid_json, invalid_status or parsed."""
    v = F.try_parse_json(F.regexp_replace(F.col(response), r"(?s)^\s*```(?:json)?|```\s*$", ""))
    get = lambda k, t: F.try_variant_get(v, f"$.{k}", t)
    status = F.lower(F.trim(get("check_status", "string")))
    df = df.withColumns({"_ok": F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "_s": status, "_c": get("confidence", "double")})
    good = F.col("_ok") & F.coalesce(F.col("_s").isin(VERDICTS), F.lit(False))
    parsed = F.when(~F.col("_ok"), "invalid_json").when(~good, "invalid_status").otherwise("parsed")
    return df.withColumns({"parse_status": parsed, "check_status": F.when(good, F.col("_s")), "confidence": F.when(good, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("_c", F.lit(0.0)))))}).drop("_ok", "_s", "_c")


def applied_verdicts(verifications: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rule verifications with the parsed verdict of their request in place of status and confidence: of several the surest, of equal ones the first status by name."""
    v = verdicts.where("parse_status = 'parsed'").groupBy("request_id").agg(F.min(F.struct((-F.col("confidence")).alias("_o"), "check_status", "confidence")).alias("_v"))
    j = verifications.join(v, "request_id", "left")
    return j.withColumns({"check_status": F.coalesce("_v.check_status", "check_status"), "confidence": F.coalesce("_v.confidence", "confidence"), "verified_by": F.when(F.col("_v").isNotNull(), "model").otherwise("rules")}).drop("_v")


def observed_urls_only(answers: DataFrame, observed: DataFrame) -> DataFrame:
    """Answers (request_id, url) whose URL the request had offered."""
    return answers.join(observed.select("request_id", "url").distinct(), ["request_id", "url"], "left_semi")


def related_history(stories: DataFrame, history: DataFrame, min_year: int, most: int = 8) -> DataFrame:
    """(story_id, item_id, rank): items that name an entity or have an event type of the story, newest first.

    Stories have story_id, entities, event_types; history item_id, entities, event_types, published_at.
    """
    from newsloom.operators.selection import top_per_group

    keys = lambda: F.explode(F.concat(F.transform("entities", lambda e: F.concat(F.lit("e:"), F.lower(e))), F.transform("event_types", lambda t: F.concat(F.lit("t:"), t))))
    recent = history.where(F.year("published_at") >= min_year)
    pairs = stories.select("story_id", keys().alias("k")).join(recent.select("item_id", "published_at", keys().alias("k")), "k").select("story_id", "item_id", "published_at").distinct()
    return top_per_group(pairs, "story_id", [F.desc("published_at"), F.col("item_id")], most).select("story_id", "item_id", "rank")


def context_class(n_sources: Column, n_cited: Column, n_total: Column) -> Column:
    """How far a story's history can be relied on."""
    return F.when(n_total == 0, "no_context").when((n_cited == n_total) & (n_sources >= 2), "well_supported").when(n_cited > 0, "partly_supported").otherwise("unsupported")
