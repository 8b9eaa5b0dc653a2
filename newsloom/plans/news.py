"""The news operators as queries over the driver's tables.

Events stand for candidates in time, suppliers for sources, pages for fetched pages, documents for the
evidence corpus, benchmark items for claims, regions for sections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import functions as fn
from newsloom.operators import audit, candidates, clusters, events, evidence, selection, stories

NOW = "2024-01-20 00:00:00"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _now():
    return F.lit(NOW).cast("timestamp")


def recency_filter_rejects(spark, d):
    e = _t(spark, d, "events")
    old = (F.col("ts") < _now() - F.expr("INTERVAL 48 HOURS")) | (F.col("ts") > _now())
    reject = F.when(F.col("ts").isNull(), "missing_time").when(old, "outside_time_window").otherwise("accepted")
    return e.groupBy("event_type", reject.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def _candidates(spark, d):
    """Events as candidates: the user is the topic, the supplier of that number the source."""
    e = _t(spark, d, "events")
    tags = F.array_compact(F.array(F.when(F.col("event_type") == "error", "controversy"), F.when(F.col("event_type") == "purchase", "hot_discussion"), F.when(F.col("event_type") == "signup", "current_update")))
    return e.select(
        F.col("event_id").alias("ordinal"), F.concat(F.lit("trending on reddit and "), "event_type").alias("title"), F.lit("").alias("snippet"), F.concat(F.lit("https://example.com/"), F.col("user_id")).alias("url"),
        F.col("user_id").cast("string").alias("source_id"), F.lit("").alias("query"), tags.alias("tags"), F.create_map(F.lit("likes"), F.col("value") * 100, F.lit("comments"), F.col("value")).alias("heat_signals"),
        F.col("ts").cast("timestamp").alias("published_at"), F.lit(None).cast("timestamp").alias("observed_at"), F.col("user_id"),
    )


def _sources(spark, d):
    none = F.lit(None).cast("array<string>")
    return _t(spark, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("source_id"), (F.col("s_suppkey") % 101).alias("priority"), F.when(F.col("s_suppkey") % 3 == 0, "community").when(F.col("s_suppkey") % 3 == 1, "official").otherwise("media").alias("kind"),
        none.alias("allowed_url_patterns"), F.array(F.lit("/13$")).alias("excluded_url_patterns"), none.alias("excluded_keywords"), none.alias("required_any_keywords"),
    )


def _memory(spark, d):
    """What was first seen in the first ten days, by URL."""
    e = _t(spark, d, "events").where(F.col("ts") < F.lit("2024-01-11").cast("timestamp"))
    return e.groupBy(F.concat(F.lit("url:https://example.com/"), F.col("user_id")).alias("memory_key")).agg(F.min(F.col("ts").cast("timestamp")).alias("first_seen_at"))


def heat_score_rank(spark, d):
    out = candidates.filter_and_rank(_candidates(spark, d), _sources(spark, d), _memory(spark, d), _now(), 240)
    return out.select("ordinal", "reject_reason", F.coalesce("heat_score", F.lit(-1.0)).alias("heat_score"), "memory_status")


def memory_freshness(spark, d):
    held = candidates.with_memory_status(_candidates(spark, d), _memory(spark, d), _now(), 240)
    return held.groupBy("memory_status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("url").alias("urls"))


def canonical_url_dups(spark, d):
    p = _t(spark, d, "pages").select("page_id", fn.canonical_url(F.col("url")).alias("canonical_url"))
    return p.groupBy("canonical_url").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))


def html_title_extract(spark, d):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return _t(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(title, "[ \t\n\r]+", " ")).alias("title"))


def html_document_parse(spark, d):
    from newsloom.functions.python import parse_page

    p = _t(spark, d, "pages").withColumn("p", parse_page("url", "html"))
    return p.select("page_id", F.col("p.title").alias("title"), F.col("p.published").alias("published"), F.length("p.content").alias("n_chars"), F.size("p.images").alias("n_images"))


def _title(c="text"):
    return F.substring_index(F.col(c), "\n", 1)


def normalized_title_clusters(spark, d):
    t = _t(spark, d, "documents").select("doc_id", fn.normalized_title(_title()).alias("title_key")).where("title_key <> ''")
    return t.groupBy("title_key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def story_cluster_cascade(spark, d):
    p = _t(spark, d, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return clusters.story_clusters(clusters.cluster_keys(p, F.col("title"), F.col("url"), F.lit("news")), "page_id")


def evidence_chunks(spark, d):
    c = evidence.chunks(_t(spark, d, "documents"), "doc_id", F.col("text"))
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("quote")).alias("n_chars"))


def bm25_search(spark, d):
    found = evidence.bm25(_t(spark, d, "documents"), "doc_id", F.col("text"), _t(spark, d, "benchmark"), "item_id", F.col("text"))
    return found.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def keyword_retrieval(spark, d):
    """The five documents that hold the most words of each item anywhere in their text; those that hold none are no evidence."""
    docs, items = _t(spark, d, "documents"), _t(spark, d, "benchmark")
    s = evidence.word_hits(docs, "doc_id", F.col("text"), items, "item_id", fn.query_tokens(F.col("text")), 5).withColumnRenamed("hits", "score")
    return selection.top_per_group(s, "item_id", [F.desc("score"), F.col("doc_id")], 5).select("item_id", "doc_id", "score", "rank")


def claim_support_status(spark, d):
    """Every item as a claim against every document."""
    docs, items = _t(spark, d, "documents"), _t(spark, d, "benchmark")
    s = evidence.word_hits(docs, "doc_id", F.col("text"), items, "item_id", fn.claim_tokens(F.col("text")))
    s = s.withColumn("support", F.when(F.col("words") == 0, F.lit(0.0)).otherwise(F.col("hits") / F.col("words")))
    kind = F.when(F.col("item_id") % 3 == 0, "news").when(F.col("item_id") % 3 == 1, "rumor").otherwise("guide")
    s = s.withColumn("st", evidence.claim_status(kind, F.lit(1), F.col("support")))
    return s.select("item_id", "doc_id", F.round("support", 6).alias("support"), F.col("st.check_status").alias("check_status"), F.col("st.confidence").alias("confidence"))


def burst_detection(spark, d):
    b = events.bursts(_t(spark, d, "events"), "user_id", "ts", "event_id", 72, 3)
    return b.select("user_id", "burst", "story_count", "duration_hours")


def event_timeline(spark, d):
    e = _t(spark, d, "events").withColumns({"is_correction": F.col("event_type") == "error", "is_official": F.col("event_type") == "purchase"})
    return events.timeline(e, ["user_id"], "ts", "event_id").select("event_id", "chronological_index", "entry_count", "entry_label")


def year_gap_patterns(spark, d):
    o = _t(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    return events.year_gaps(o, "o_custkey", "y", 2004)


def title_jaccard_pairs(spark, d):
    found = clusters.token_pairs(_t(spark, d, "documents"), "doc_id", fn.tokens(_title()), F.col("source"), 0.65)
    return found.select(F.col("block").alias("source"), "id_a", "id_b", F.round("similarity", 6).alias("similarity"))


def url_similarity_pairs(spark, d):
    p = _t(spark, d, "pages").select("page_id", fn.canonical_url(F.col("url")).alias("u")).groupBy("u").agg(F.min("page_id").alias("page_id"))
    return clusters.path_pairs(p.where("u <> ''"), "page_id", F.col("u"), 0.3).select(F.col("id_a").alias("page_id_a"), F.col("id_b").alias("page_id_b"), "similarity")


def _section_pool(spark, d):
    """Orders as candidates of their customer's region."""
    place = _t(spark, d, "customer").join(F.broadcast(_t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("section"))
    return _t(spark, d, "orders").join(place, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "section", "o_totalprice", F.col("o_orderpriority").substr(1, 1).cast("int").alias("priority"))


_POOL_ORDER = lambda: [F.asc("priority"), F.desc("o_totalprice"), F.asc("o_orderkey")]


def section_topk_pool(spark, d):
    return selection.top_per_group(_section_pool(spark, d), "section", _POOL_ORDER(), 20).select("section", "o_orderkey", "rank")


def section_final_selection(spark, d):
    pool = selection.top_per_group(_section_pool(spark, d), "section", _POOL_ORDER(), 20, "pool_rank")
    score = F.round(F.col("o_totalprice") / 1000 + F.when(F.col("priority") == 1, 12.0).when(F.col("priority") == 2, 8.0).otherwise(0.0), 6)
    final = selection.top_per_group(pool.withColumn("score", score), "section", [F.desc("score"), F.asc("o_orderkey")], 10)
    return final.select("section", "o_orderkey", "score", "rank")


def underfilled_backfill(spark, d):
    pool = _section_pool(spark, d)
    final = selection.top_per_group(pool.where("priority = 1 and o_totalprice > 300000"), "section", _POOL_ORDER(), 10)
    sections = _t(spark, d, "region").select(F.col("r_regionkey").alias("section"))
    short = selection.underfilled(final, sections, "section", 200)
    return selection.backfill(pool, final, short, "section", "o_orderkey", _POOL_ORDER()).select("section", "o_orderkey", "fill_rank")


def source_dominance(spark, d):
    li, s = _t(spark, d, "lineitem"), _t(spark, d, "supplier")
    stats = li.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("candidate_count"), F.sum(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("document_count"), F.sum(F.when(F.col("l_discount") > 0.09, 1).otherwise(0)).alias("title_heat"),
        F.sum(F.when(F.col("l_quantity") > 49, 1).otherwise(0)).alias("engaged"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("noise"),
    )
    named = stats.join(s, F.col("l_suppkey") == F.col("s_suppkey")).drop("l_suppkey", "s_name", "s_nationkey", "s_acctbal")
    out = audit.dominance(named, "s_suppkey")
    return out.select("s_suppkey", "candidate_count", "candidate_share", "document_coverage", "noise_ratio", "dominant", F.array_join("reasons", ",").alias("reasons"))


def source_theme_pivot(spark, d):
    li = _t(spark, d, "lineitem").join(_t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    n = lambda flag, status: F.sum(F.when((F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status), 1).otherwise(0)).alias(f"{flag}_{status}".lower())
    counts = li.groupBy("s_nationkey").agg(*(n(f, s) for f in "ANR" for s in "FO"), F.count(F.lit(1)).alias("total"))
    return counts.join(F.broadcast(_t(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).drop("s_nationkey", "n_nationkey", "n_regionkey")


def source_health(spark, d):
    e = _t(spark, d, "events")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = e.groupBy("user_id").agg(
        n(F.col("event_type") == "purchase").alias("accepted"), n(F.col("event_type") == "view").alias("rejected"), n((F.col("event_type") == "error") & (F.col("value") < 2)).alias("blocked"),
        n((F.col("event_type") == "error") & (F.col("value") >= 15)).alias("errors"), F.count(F.lit(1)).alias("fetched"),
    )
    return audit.health(counts, "user_id").select("user_id", "accepted", "rejected", "errors", "status")


def stage_funnel_bottleneck(spark, d):
    pool, li = _section_pool(spark, d), _t(spark, d, "lineitem")
    lines = li.groupBy("l_orderkey").agg(F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"), F.max(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("closed"))
    j = pool.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = j.groupBy("section").agg(
        F.count(F.lit(1)).alias("source_accepted_count"), n(F.col("priority") <= 4).alias("candidate_count"), n(F.col("priority") <= 4).alias("pool_count"), n(F.col("priority") <= 4).alias("fetch_selected_count"),
        n((F.col("priority") <= 4) & F.col("l_orderkey").isNotNull()).alias("context_pack_count"), n((F.col("priority") <= 4) & (F.col("closed") == 1)).alias("claim_verification_count"),
        n((F.col("priority") <= 4) & (F.col("closed") == 1) & (F.col("returned") == 0)).alias("story_candidate_count"),
    )
    counts = counts.withColumn("final_selected_count", F.least("story_candidate_count", F.lit(10).cast("long")))
    return counts.withColumn("primary_bottleneck", audit.bottleneck()).select("section", "pool_count", "context_pack_count", "claim_verification_count", "story_candidate_count", "final_selected_count", "primary_bottleneck")


def discussion_profile(spark, d):
    c = _t(spark, d, "conversations")
    per = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).alias("asked"), F.sum(F.length("text")).alias("chars"))
    cand = per.select(
        F.col("conv_id"), F.when(F.col("turns") > 5, "goes viral on reddit and steam").otherwise("players debating").alias("title"), F.lit("").alias("snippet"), F.lit("").alias("query"), F.lit("").alias("url"), F.lit("").alias("source_id"),
        F.when(F.col("asked") > 3, F.array(F.lit("hot_discussion"))).otherwise(F.array().cast("array<string>")).alias("tags"), F.create_map(F.lit("comments"), F.col("turns").cast("double"), F.lit("views"), F.col("chars").cast("double")).alias("heat_signals"),
    )
    p = F.col("discussion_profile")
    return candidates.with_discussion(cand).select("conv_id", p["score"].alias("score"), p["level"].alias("level"), F.array_join(p["platforms"], ",").alias("platforms"), p["has_discussion_evidence"].alias("has_evidence"))


def quality_scorecard(spark, d):
    pct = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
    e = _t(spark, d, "events").agg(pct(F.col("event_type") != "error").alias("collection"), pct(F.col("value") > 5).alias("filtering"))
    x = _t(spark, d, "documents").agg(pct(F.length("text") >= 200).alias("evidence"))
    v = _t(spark, d, "labels").agg(pct(F.col("quality") == 1).alias("verification"), pct(F.col("toxic") == 0).alias("selection"))
    p = _t(spark, d, "pages").agg(pct(F.col("html").contains("<title>")).alias("packaging"))
    one = e.crossJoin(x).crossJoin(v).crossJoin(p)  # rows of totals
    score = audit.overall_quality({k: F.col(k) for k in audit.STAGE_WEIGHTS})
    return one.select(*(F.round(k, 4).alias(k) for k in audit.STAGE_WEIGHTS), score.alias("overall"), audit.readiness(score).alias("readiness"))


def quality_flags(spark, d):
    title = F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    short = _t(spark, d, "pages").where(F.length(title) < 40).select(F.lit("short_title").alias("flag"), F.col("page_id").alias("item_id"))
    empty = _t(spark, d, "documents").where(F.length(F.trim("text")) < 40).select(F.lit("empty_document_content").alias("flag"), F.col("doc_id").alias("item_id"))
    return short.unionByName(empty)


def schema_validation_errors(spark, d):
    j = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    return audit.contract_errors(j, "doc_id", ["text", "source", "quality"], [["toxic", "lang"]]).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def stratified_eval_sample(spark, d):
    return selection.stratified_sample(_t(spark, d, "documents"), "lang", [F.col("doc_id")], 100).select("doc_id", "lang")


def round_robin_requests(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.col("lang"), _title().alias("query"))
    pos = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).when(F.col("lang") == "fr", 2).otherwise(3)
    return selection.round_robin(docs.withColumn("pos", pos), "lang", "pos", "query", "doc_id", 40).select("request_no", "doc_id", "lang")


def news_item_upsert(spark, d):
    """Pages of the first half as stored items, of the second half as a new run: first_seen stays, the rest is replaced."""
    p = _t(spark, d, "pages").select("page_id", fn.canonical_url(F.col("url")).alias("u"), F.length("html").alias("n"))
    item = lambda df: df.groupBy(fn.short_hash(F.col("u"), "news_").alias("item_id")).agg(F.min("page_id").alias("seen"), F.max_by("n", "page_id").alias("n"))
    old, new = item(p.where("page_id % 2 = 0")).alias("o"), item(p.where("page_id % 2 = 1")).alias("n")
    both = old.join(new, "item_id", "full_outer")
    return both.select("item_id", F.coalesce("o.seen", "n.seen").alias("first_seen"), F.coalesce("n.n", "o.n").alias("n_chars"))


def json_props_filter(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return _t(spark, d, "events").where(k >= 50).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).cast("long").alias("k"))


def ranked_stories(spark, d):
    li = _t(spark, d, "lineitem")
    status = F.when(F.col("l_returnflag") == "N", "likely").when(F.col("l_returnflag") == "A", "rumor").otherwise("reject")
    claims = li.select(
        F.col("l_orderkey").alias("story_id"), F.col("l_linenumber").alias("ordinal"), F.concat(F.lit("claim "), F.col("l_linenumber")).alias("text"), status.alias("check_status"), (F.col("l_discount") * 5).alias("confidence"),
        F.col("l_quantity").alias("heat_score"), (F.col("l_tax") * 100).alias("discussion_score"), F.col("l_suppkey").alias("url"), (F.col("l_linestatus") == "O").alias("is_preferred_language"),
    )
    return stories.ranked_stories(claims)
