"""Search expansion and verification as request tables: what is asked of a model or a search page, and what its answers change.

Requests have request_id, method, query, theme_section, request_no; answers are JSON texts keyed by request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import functions as fn
from newsloom.operators.selection import round_robin, top_per_group
from newsloom.operators.social import SEARCH_URLS

# Names of events, those that name none, and words of new content.
EVENT_NAMES = {
    "summer game fest": "Summer Game Fest", "xbox games showcase": "Xbox Games Showcase", "state of play": "State of Play", "nintendo direct": "Nintendo Direct", "gamescom": "gamescom", "tokyo game show": "Tokyo Game Show",
    "the game awards": "The Game Awards", "showcase": "showcase", "direct": "Direct", "游戏节": "游戏节", "游戏展": "游戏展", "发布会": "发布会", "直面会": "直面会", "展示会": "展示会",
}
GENERIC_EVENTS = ["showcase", "Direct", "游戏节", "游戏展", "发布会", "直面会", "展示会"]
NEW_CONTENT = ["announced", "reveal", "reveals", "revealed", "new trailer", "release date", "demo", "world premiere", "gameplay trailer", "公布", "公开", "新作", "新预告", "发售日", "试玩", "实机", "首曝"]
# Methods whose queries are compressed, and answers by which a result is left out.
COMPRESSED_METHODS = ["candidate_followup", "event_burst", "new_content_watch"]
REJECTED_RELEVANCE = ["reject"]

# Methods in order, themes in order with their seeds and the number that fills them, templates, and what candidates' titles are searched with.
METHODS = ["theme_gap", "event_burst", "candidate_followup", "new_content_watch"]
THEME_SEEDS = {
    "nintendo": ["Switch 2 玩家 热议", "任天堂 新作 曝光 玩家反馈", "Switch 2 涨价 争议"], "sony": ["PlayStation PS5 玩家 热议", "索尼 游戏 争议 玩家", "PS5 新作 爆料 玩家讨论"], "microsoft": ["Xbox 玩家 热议", "微软 游戏 独占 争议", "Game Pass 新作 玩家讨论"],
    "pc": ["Steam 新作 玩家 热议", "PC 游戏 争议 评论区", "Steam 差评 玩家讨论"], "supplemental": ["游戏 梗图 玩家 离谱操作", "游戏 聊天截图 热议", "玩家 操作 笑疯 转发"],
}
THEME_TARGET = 20
BURST_TEMPLATES = [
    ("pc", "{} new games trailer release date discussion"), ("microsoft", "Xbox {} new games player reactions"), ("sony", "PlayStation {} new games player reactions"), ("nintendo", "Nintendo {} new games player reactions"), ("supplemental", "{} memes player reactions"),
]
WATCH_TEMPLATES = [
    ("pc", "{} new game announced trailer player discussion"), ("microsoft", "{} Xbox new game reveal player discussion"), ("sony", "{} PlayStation new game reveal player discussion"), ("nintendo", "{} Nintendo new game reveal player discussion"), ("supplemental", "{} game showcase memes player reactions"),
]
DISCUSSION_WORDS = "玩家讨论 热议"
PLATFORMS = ["bilibili", "weibo"]


def query_text(text: Column, most: int = 96) -> Column:
    """Without URLs and brackets, white space collapsed, cut at the last space within ``most`` characters."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"https?://\S+", " "), r"[\[\]{}()|<>]", " ")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    cut = F.substring(t, 1, most)
    whole = F.trim(F.regexp_replace(cut, r" [^ ]*$", ""))
    return F.when(F.length(t) <= most, t).otherwise(F.when(whole != "", whole).otherwise(F.trim(cut)))


def search_targets(query: Column, platforms: list[str] = PLATFORMS) -> Column:
    """An array of (platform, query, url, access) for a query."""
    url = lambda p: F.replace(F.lit(SEARCH_URLS[p]), F.lit("{}"), fn.quote_plus(query)) if p in ("bilibili", "weibo", "reddit", "steam") else F.lit("")
    access = lambda p: F.lit("public_search_page" if p in ("bilibili", "weibo", "reddit", "steam") else "manual_or_api_required")
    return F.array(*(F.struct(F.lit(p).alias("platform"), query.alias("query"), url(p).alias("url"), access(p).alias("access")) for p in platforms))


def expansion_requests(topic: str, theme_counts: DataFrame, candidates: DataFrame, ordinal: str, methods: list[str] = METHODS, limit: int = 10, platforms: list[str] = PLATFORMS) -> DataFrame:
    """(request_id, request_no, method, theme_section, query, usage_policy, quota_policy, source_candidate_url, source_candidate_title, search_targets): ``limit`` searches, in turn from the methods.

    theme_gap asks the seeds of the themes with the fewest candidates (theme, n) first; event_burst and
    new_content_watch ask for the event that candidates speak of; candidate_followup for what is said
    about the first candidates with title and URL. A query stands once, whatever its case.
    """
    spark = theme_counts.sparkSession
    seeds = spark.createDataFrame([(t, i, j, q) for i, (t, qs) in enumerate(THEME_SEEDS.items()) for j, q in enumerate(qs)], "theme_section string, theme_no int, seed_no int, seed string")
    n = theme_counts.groupBy(F.col("theme").alias("theme_section")).agg(F.sum("n").alias("n"))
    counted = seeds.join(n, "theme_section", "left").withColumn("n", F.coalesce("n", F.lit(0)))  # a row for each seed
    gap = F.concat(F.col("seed"), F.lit(f" {topic}")) if topic and topic.lower() != "games" else F.col("seed")
    none = F.lit(None).cast("string")
    row = lambda df, method, at, query, policy, quota=none, url=none, title=none: df.select(F.lit(method).alias("method"), F.lit(METHODS.index(method) if method not in methods else methods.index(method)).alias("pos"), at.alias("at"), "theme_section", query.alias("query"), F.lit(policy).alias("usage_policy"), quota.alias("quota_policy"), url.alias("source_candidate_url"), title.alias("source_candidate_title"))
    place = F.concat_ws(".", *(F.lpad(F.col(f"o.{c}").cast("string"), 12, "0") for c in ("seed_no", "full", "n", "theme_no")))
    parts = [row(counted.withColumn("o", F.struct("seed_no", (F.col("n") >= THEME_TARGET).cast("int").alias("full"), "n", "theme_no")), "theme_gap", place, gap, "low_frequency_search_expansion")]
    context = event_context(candidates, ordinal).where("active").select(F.coalesce(F.nullif(F.trim("event_name"), F.lit("")), F.lit("game showcase")).alias("name"))
    for method, templates, policy in (("event_burst", BURST_TEMPLATES, "event_burst_search_expansion"), ("new_content_watch", WATCH_TEMPLATES, "new_content_watch_search_expansion")):
        made = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(templates)], "i int, theme_section string, template string").crossJoin(F.broadcast(context))  # one row at most
        text = F.replace(F.col("template"), F.lit("{}"), F.col("name"))
        if method == "event_burst":
            text = F.regexp_replace(text, r"(?i)\b(Xbox|PlayStation|Nintendo)\s+\1\b", "$1")
        parts.append(row(made, method, F.lpad(F.col("i").cast("string"), 12, "0"), query_text(text), policy, F.lit("event_burst_briefing_candidate")))
    named = candidates.select(ordinal, query_text(F.col("title")).alias("t"), fn.clean(F.col("url")).alias("u"), F.coalesce(F.nullif(F.col("theme_section"), F.lit("")), F.lit("supplemental")).alias("theme_section"), F.lit(1).alias("_all"))
    first = top_per_group(named.where("t <> '' AND u <> ''"), "_all", [F.col(ordinal)], max(limit, 0))
    parts.append(row(first, "candidate_followup", F.lpad(F.col("rank").cast("string"), 12, "0"), query_text(F.concat("t", F.lit(f" {DISCUSSION_WORDS}"))), "candidate_followup_search_expansion", url=F.col("u"), title=F.col("t")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.where(F.col("method").isin(methods) & (F.trim("query") != "")).withColumn("_key", F.lower(F.trim("query")))
    picked = round_robin(every, "method", "pos", "_key", "at", max(limit, 0))
    identity = F.concat_ws("-", F.lit("search-expansion"), "method", "theme_section", F.col("request_no").cast("string"))
    return picked.select(identity.alias("request_id"), "request_no", "method", "theme_section", "query", "usage_policy", "quota_policy", "source_candidate_url", "source_candidate_title", search_targets(F.col("query"), platforms).alias("search_targets"))


def event_context(candidates: DataFrame, ordinal: str, threshold: int = 2) -> DataFrame:
    """One row: active, event_name, event_signal_count, new_content_signal_count, quota_policy: whether candidates look like the day of a showcase.

    Each keyword counts once over all candidates. The name is that of the keyword seen first, by
    candidate and then in the table's order, a specific one before a generic one.
    """
    text = fn.join_text(F.col("title"), F.col("snippet"), F.col("query"))
    entry = lambda i, kind, word, label: F.when(F.contains(text, F.lit(word)), F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("i"), F.lit(label).alias("label")))
    found = F.array_compact(F.array(*(entry(i, "event", w, v) for i, (w, v) in enumerate(EVENT_NAMES.items())), *(entry(i, "new", w, w) for i, w in enumerate(NEW_CONTENT))))
    hits = candidates.select(F.col(ordinal).alias("o"), F.explode(found).alias("f")).groupBy("f.kind", "f.i", "f.label").agg(F.min("o").alias("o"))  # a row per keyword
    is_event, special = F.col("kind") == "event", ~F.col("label").isin(GENERIC_EVENTS)
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    first = lambda c: F.min_by(F.when(c, F.col("label")), F.when(c, F.struct("o", "i")))
    one = hits.agg(n(is_event).alias("event_signal_count"), n(~is_event).alias("new_content_signal_count"), F.coalesce(first(is_event & special), first(is_event), F.lit("")).alias("name"))
    active = ((F.col("event_signal_count") > 0) & (F.col("new_content_signal_count") > 0)) | (F.col("new_content_signal_count") >= max(threshold + 1, 3))
    named = F.when((F.col("name") == "") & active, "game showcase").otherwise(F.col("name"))
    return one.select(active.alias("active"), named.alias("event_name"), "event_signal_count", "new_content_signal_count", F.when(active, "event_burst").otherwise("normal").alias("quota_policy"))


def compression_requests(requests: DataFrame, limit: int) -> DataFrame:
    """(request_id, source_request_id, method, fallback_query) of the first ``limit`` requests of a method that is compressed."""
    held = requests.where(F.col("method").isin(COMPRESSED_METHODS) & (fn.clean(F.col("request_id")) != "")).withColumn("_all", F.lit(1))
    first = top_per_group(held, "_all", [F.col("request_no")], max(limit, 0))
    return first.select(F.concat(F.lit("query-compression-"), "request_id").alias("request_id"), F.col("request_id").alias("source_request_id"), "method", F.coalesce("query", F.lit("")).alias("fallback_query"))


def compressed_queries(answers: DataFrame, max_chars: int = 24, max_spaces: int = 3) -> DataFrame:
    """(source_request_id, parse_status, queries, confidence) of model answers: up to three distinct queries that can be used, confidence from 0 to 1."""
    j = F.from_json(F.coalesce("raw_response", F.lit("")), "queries array<string>, confidence double, source_request_id string")
    object_ = F.get_json_object("raw_response", "$").isNotNull() & F.startswith(F.trim("raw_response"), F.lit("{"))
    usable = F.filter(F.transform(F.coalesce(j["queries"], F.array().cast("array<string>")), fn.clean), lambda q: (q != "") & (F.length(q) <= max_chars) & (F.length(q) - F.length(F.replace(q, F.lit(" "), F.lit(""))) <= max_spaces))
    own = F.regexp_replace("request_id", "^query-compression-", "")
    return answers.select(
        F.when(object_, F.coalesce(F.nullif(j["source_request_id"], F.lit("")), own)).otherwise(own).alias("source_request_id"), F.when(object_, "parsed").otherwise("invalid_json").alias("parse_status"),
        F.when(object_, F.slice(F.array_distinct(usable), 1, 3)).otherwise(F.array().cast("array<string>")).alias("queries"), F.when(object_, F.least(F.greatest(F.coalesce(j["confidence"], F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0).alias("confidence"), *(["answer_no"] if "answer_no" in answers.columns else []),
    )


def with_compressed_queries(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests with the first query of their answer; query_source is llm_compressed, fallback, or null without an answer. 

    Of answers to one request the last by answer_no holds where there is such a column, else a parsed one, the first by its text.
    """
    order = F.col("answer_no") if "answer_no" in answers.columns else F.struct(F.when(F.col("parse_status") == "parsed", 1).otherwise(0), F.hash("queries"), "confidence")
    of = compressed_queries(answers).groupBy("source_request_id").agg(F.max_by(F.struct("parse_status", "queries"), order).alias("_a"))
    joined = requests.join(of, F.col("request_id") == F.col("source_request_id"), "left")
    chosen = F.when(F.col("_a.parse_status") == "parsed", F.try_element_at("_a.queries", F.lit(1)))
    out = joined.withColumns({"fallback_query": F.when(F.col("_a").isNotNull(), F.col("query")), "query_source": F.when(F.col("_a").isNull(), None).when(chosen.isNotNull(), "llm_compressed").otherwise("fallback")})
    return out.withColumn("query", F.coalesce(chosen, F.col("query"))).drop("source_request_id", "_a")


def with_relevance(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """Results (request_id, platform, url) with llm_relevance and llm_rejected; no row is dropped. A decision has the same keys, relevance and decision_no; the last holds."""
    last = decisions.where(fn.clean(F.col("url")) != "").groupBy("request_id", "platform", "url").agg(F.max_by("relevance", "decision_no").alias("llm_relevance"))
    out = results.join(last, ["request_id", "platform", "url"], "left")
    return out.withColumn("llm_rejected", F.coalesce(F.col("llm_relevance").isin(REJECTED_RELEVANCE), F.lit(False)))


def verification_requests(claims: DataFrame, packs: DataFrame, max_evidence: int = 5) -> DataFrame:
    """(request_id, claim_id, text, rule_check_status, evidence): each claim with the evidence of its pack, else its own, ``max_evidence`` at most.

    The request is named after the claim, so that several claims of a story have one each; after its story or text without an id.
    """
    own = "evidence" in claims.columns
    joined = claims.withColumnRenamed("evidence", "_own").join(packs.select(F.col("candidate_id").alias("claim_id"), "evidence"), "claim_id", "left")
    if own:
        joined = joined.withColumn("evidence", F.when(F.size(F.coalesce("evidence", F.array().cast(packs.schema["evidence"].dataType))) > 0, F.col("evidence")).otherwise(F.col("_own")))
    return joined.select(
        F.coalesce(*(F.nullif(fn.clean(F.col(c).cast("string")), F.lit("")) for c in ("claim_id", "story_id", "text")), F.lit("")).alias("request_id"), "claim_id", "text", F.col("check_status").alias("rule_check_status"), F.slice("evidence", 1, max_evidence).alias("evidence"),
    )
