"""The middle of the news chain, the event store and the reports by source as queries, each with its SQL.

Pages stand for candidates and, those of even number, for fetched documents; orders for stories of a
customer's game; events for the stages that a source (the user) passes through.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import functions as fn
from newsloom.operators import event_store, events, newsroom, packs, probes, reports, requests
from newsloom.plans.news_sql import _CLAIM_STOP, _HTML_TITLE, _STOP, _canon, _words


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pages(spark, d):
    """Pages as candidates; those of number 3, 10, 17 have no title."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    n = F.col("page_id")
    return _t(spark, d, "pages").select(
        n.alias("candidate_id"),
        F.when(n % 7 == 3, "").otherwise(title).alias("title"),
        F.lit("").alias("snippet"),
        F.when(n % 3 == 0, F.regexp_extract("html", "<p>([^<]*)<", 1)).otherwise("").alias("query"),
        "url",
        fn.url_host(F.col("url")).alias("source_id"),
        F.element_at(F.array(*(F.lit(x) for x in ("news", "rumor", "guide", "fact", "discussion_search_lead"))), (n % 5 + 1).cast("int")).alias("candidate_type"),
        F.when(n % 4 != 1, F.timestamp_seconds(1_700_000_000 + n * 3600)).alias("published_at"),
        F.lit(None).cast("timestamp").alias("observed_at"),
    )


def _chunks(spark, d):
    """The pages of even number as chunks: title and first paragraph."""
    title, n = F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.col("page_id")
    return _t(spark, d, "pages").where("page_id % 2 = 0").select(
        n.alias("chunk_id"), n.alias("chunk_no"), "url", title.alias("title"), F.regexp_extract("html", "<p>([^<]*)<", 1).alias("quote"), F.timestamp_seconds(1_700_000_000 + n * 3600).alias("published_at"),
        fn.url_host(F.col("url")).alias("source_id"), F.when(n % 3 == 0, "pc").when(n % 3 == 1, "sony").alias("theme_section"),
    )


def context_packs(spark, d):
    p = packs.context_packs(_pages(spark, d), _chunks(spark, d))
    ids = F.array_join(F.transform("evidence", lambda e: e["chunk_id"]), ",")
    return p.select("candidate_id", "evidence_scope", F.size("evidence").alias("n_evidence"), ids.alias("chunks"), F.array_join("missing_fields", ",").alias("missing"))


def claims_from_packs(spark, d):
    c = packs.claims(packs.context_packs(_pages(spark, d), _chunks(spark, d)))
    return c.select("claim_id", "text", "story_id", "claim_type", "extraction_status", F.array_join("source_urls", " ").alias("urls"), F.array_join("evidence_chunk_ids", ",").alias("chunks"))


def claims_verified(spark, d):
    """Claims against the chunks of their packs: candidates without a document of their own have none."""
    chunks = _chunks(spark, d)
    c = packs.verified_claims(packs.claims(packs.context_packs(_pages(spark, d), chunks)), chunks)
    return c.select("claim_id", "n_evidence", "support_score", "check_status", "confidence", "verification_reason")


def evidence_with_filters(spark, d):
    """Retrieval for benchmark items among the chunks of a section and a time window, statistics of all."""
    where = packs.passes_filters(theme_sections=["pc"], start=F.timestamp_seconds(F.lit(1_700_000_000 + 20 * 3600)))
    q = _t(spark, d, "benchmark").select("item_id", "text")
    found = packs.retrieve_evidence(q, "item_id", F.col("text"), _chunks(spark, d), where=where)
    return found.select("item_id", "retriever", "chunk_id", F.round("score", 6).alias("score"), "rank")


def fact_inference_split(spark, d):
    s = packs.fact_and_inference(F.concat(F.col("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, " announced a price increase due to costs of ").when(F.col("c_custkey") % 3 == 1, " 因为 ").otherwise(" and "), F.col("c_name")))
    return _t(spark, d, "customer").select("c_custkey", s.alias("s")).select("c_custkey", "s.*")


def story_event_types(spark, d):
    text = F.concat("o_orderpriority", F.lit(" "), "o_orderstatus", F.when(F.col("o_orderkey") % 4 == 0, " patch notes").when(F.col("o_orderkey") % 4 == 1, " 爆料 update").otherwise(""))
    kind = F.when(F.col("o_orderkey") % 5 == 0, "review_score").otherwise("news")
    o = _t(spark, d, "orders").select("o_orderkey", events.event_type(text, kind).alias("event_type"), F.array_join(events.history_types(text), ",").alias("history"))
    return o.groupBy("event_type", "history").agg(F.count(F.lit(1)).alias("n"))


def _stories(spark, d):
    """Orders as stories about a customer's game; their source URLs are pages."""
    o = _t(spark, d, "orders").where("o_orderkey % 4 = 0")
    pages = _t(spark, d, "pages").select("page_id", "url")
    n = F.lit(pages.count())
    kind = F.element_at(F.array(*(F.lit(x) for x in ("confirmed_report", "leak_or_rumor", "general_news"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    s = o.select(
        F.col("o_orderkey").alias("ordinal"), F.concat(F.lit("story "), (F.col("o_orderkey") % 500).cast("string")).alias("title"), kind.alias("event_type"),
        F.when(F.col("o_orderkey") % 7 == 0, "correction").otherwise("initial_report").alias("event_label"), F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("Game "), (F.col("o_custkey") % 50).cast("string"))).alias("game_title"),
        F.least(F.col("o_totalprice") / 5000, F.lit(100.0)).alias("confidence"), F.col("o_orderdate").cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("ended_at"), F.lit("").alias("parent_event_id"),
        (F.col("o_orderkey") % n).alias("page_id"),
    )
    return s.join(pages, "page_id").withColumn("source_urls", F.array("url")).drop("url", "page_id")


def _news_items(spark, d):
    p = _t(spark, d, "pages").where("page_id % 3 > 0").select("page_id", fn.canonical_url(F.col("url")).alias("u")).groupBy("u").agg(F.min("page_id").alias("page_id"))
    return p.select(event_store.hash_id("ni", F.col("u")).alias("news_item_id"), F.concat(F.lit("page "), "page_id").alias("title"), fn.url_host(F.col("u")).alias("source_id"), F.timestamp_seconds(1_700_000_000 + F.col("page_id")).alias("published_at"))


def story_events(spark, d):
    e = event_store.events(_stories(spark, d))
    return e.select("event_id", "title", "event_type", "game_id", F.date_format("started_at", "yyyy-MM-dd").alias("started"))


def event_news_links(spark, d):
    return event_store.news_links(_stories(spark, d), _news_items(spark, d)).select("event_id", "news_item_id", "game_id", "role", "confidence")


def news_game_links(spark, d):
    links = event_store.news_links(_stories(spark, d), _news_items(spark, d))
    return event_store.game_links(links).select("news_item_id", "game_id", "match_method", "confidence")


def game_event_timeline(spark, d):
    """Events of the 900 days before a date, with their news items in order."""
    stories, items = _stories(spark, d), _news_items(spark, d)
    found = event_store.event_timeline(event_store.events(stories), event_store.news_links(stories, items), items, F.lit("1998-08-03").cast("timestamp"), 900)
    return found.select("event_id", F.date_format("started_at", "yyyy-MM-dd").alias("started"), F.array_join(F.transform("news_items", lambda x: x["title"]), ",").alias("news"))


def _stages(spark, d):
    """The events of a user as stages of a source."""
    e = _t(spark, d, "events").withColumn("source_id", F.col("user_id").cast("string"))
    section = F.element_at(F.array(*(F.lit(x) for x in reports.SECTIONS)), (F.col("event_id") % 5 + 1).cast("int"))
    e = e.withColumns({"theme_section": section, "reject_reason": F.when(F.col("value") > 10, "outside_time_window").when(F.col("value") > 5, "missing_time")})
    e = e.withColumns({"published_at": F.when(F.col("event_id") % 3 > 0, F.col("ts")), "observed_at": F.lit(None).cast("timestamp")})
    return {k: e.where(f"event_type = '{k}'") for k in ("view", "click", "error", "purchase", "signup")} | {"all": e}


def source_theme_counts(spark, d):
    s = _stages(spark, d)
    out = reports.source_theme_counts(s["view"], s["all"], s["purchase"], s["signup"], s["error"])
    reasons = F.array_join(F.transform(F.map_entries(F.coalesce("reject_reasons", F.create_map().cast("map<string,bigint>"))), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return out.withColumn("reject_reasons", reasons).drop(*(f"supplemental_{x}" for x in reports.SECTIONS))


def collector_diagnostics(spark, d):
    s = _stages(spark, d)
    sources = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"), F.lit("rss").alias("collector"))
    entries = s["click"].select("source_id", F.lit(3).alias("link_count"), (F.col("event_id") % 2).alias("duplicate_url_count"), F.lit(0).alias("detail_time_backfill_count"), (F.col("event_id") % 5).alias("parse_warning_count"))
    out = reports.collector_diagnostics(sources, s["view"], s["purchase"], s["error"], s["signup"], entries)
    return out.drop("reject_reasons", "detail_time_backfill_count", "collector")


def source_selection_diagnostics(spark, d):
    s = _stages(spark, d)
    counts = reports.source_theme_counts(s["view"], s["all"], s["purchase"], s["signup"], s["error"])
    scope = F.when(F.col("event_id") % 2 == 0, "candidate_url").when(F.col("event_id") % 3 == 0, "retrieved_context").otherwise("none")
    p = s["purchase"].withColumns({"evidence_scope": scope, "missing_fields": F.when(F.col("event_id") % 4 == 0, F.array(F.lit("time"))).otherwise(F.array().cast("array<string>"))})
    pick = lambda k: s["purchase"].where(f"event_id % {k} = 0")
    out = reports.selection_diagnostics(counts, s["purchase"], pick(2), pick(4), pick(8), p, s["error"].where("value > 15"))
    return out.withColumn("diagnostic_reasons", F.array_join("diagnostic_reasons", ","))


def source_health_warnings(spark, d):
    e = _t(spark, d, "events")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    h = e.groupBy(F.col("user_id").cast("string").alias("source_id")).agg(n(F.col("event_type") == "error").alias("error_count"), n(F.col("event_type") == "purchase").alias("candidate_count"))
    h = h.withColumn("status", F.when(F.col("candidate_count") >= 14, "healthy").when(F.col("error_count") > 12, "source_broken").otherwise("needs_fill"))
    return reports.health_warnings(h).drop("status")


def fallback_warnings(spark, d):
    r = _t(spark, d, "events").select(F.concat("event_type", F.lit("_"), (F.col("user_id") % 20).cast("string")).alias("task_type"), F.when(F.col("value") > 8, "failure").when(F.col("value") > 6, "fallback_used").otherwise("success").alias("status"))
    return reports.fallback_warnings(reports.shadow_task_stats(r), 0.4)


def _probe_candidates(spark, d):
    """Conversations as candidates of a discussion."""
    c = _t(spark, d, "conversations").where("turn = 0")
    n = F.col("conv_id")
    pick = lambda *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (n % len(xs) + 1).cast("int"))
    return c.select(
        n.alias("ordinal"), F.concat(F.lit("Topic  "), (n % 90).cast("string"), pick(" | IGN news", " - report", "")).alias("title"), F.lit("").alias("snippet"), F.lit("").alias("query"),
        F.when(n % 6 > 0, F.concat(F.lit("https://example.com/"), (n % 120).cast("string"))).alias("url"), pick("ign", "bilibili", "other").alias("source_id"), F.lit(None).cast("string").alias("language"),
        pick("news", "guide", "general_tech", "manual_review").alias("candidate_type"), pick("main", "supplemental").alias("candidate_lane"), (n % 40).cast("double").alias("discussion_score"), F.lit("weak").alias("discussion_level"),
        F.struct((n % 40).cast("double").alias("score"), F.lit("weak").alias("level"), F.lit(False).alias("has_discussion_evidence")).alias("discussion_profile"),
    )


def discussion_probe_requests(spark, d):
    return probes.probe_requests(_probe_candidates(spark, d), "ordinal", 25)


def discussion_probes_applied(spark, d):
    p = _t(spark, d, "pages").where("page_id % 2 = 1")
    score = (F.col("page_id") % 80).cast("double")
    profile = F.struct(score.alias("score"), F.when(score >= 70, "trending").when(score >= 35, "discussed").otherwise("weak").alias("level"), (F.col("page_id") % 5 == 0).alias("has_discussion_evidence"))
    results = p.select(F.concat(F.lit("https://example.com/"), (F.col("page_id") % 120).cast("string")).alias("candidate_url"), F.col("page_id").alias("probe_no"), profile.alias("discussion_profile"))
    return probes.apply_probes(_probe_candidates(spark, d), results).select("ordinal", "discussion_probe_status", "discussion_score", "discussion_level")


def editorial_judgment_requests(spark, d):
    return probes.judgment_requests(_probe_candidates(spark, d), "ordinal", 30).withColumn("reasons", F.array_join("reasons", ","))


def _diagnosed(spark, d):
    """Parts as sources with counts that follow from their number."""
    n = F.col("p_partkey")
    pick = lambda *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (n % len(xs) + 1).cast("int"))
    return _t(spark, d, "part").select(
        n.cast("string").alias("source_id"), pick("media_rss", "official_rss", "web").alias("collector"), (n % 13).alias("candidate_count"), (n % 2).alias("raw_fetch_count"), (n % 4).alias("error_count"), F.lit(0).alias("health_errors"),
        (n % 200).alias("link_count"), (n % 7).alias("missing_time_count"), (n % 6).alias("duplicate_url_count"), (n % 50).alias("irrelevant_rejects"), (n % 3).alias("missing_time_rejects"), (n % 5).alias("rejected_missing_time_count"),
        (n % 9).alias("parse_warning_count"), pick("ok", "ok", "ok", "source_blocked").alias("health_status"), F.create_map(F.lit("irrelevant_topic"), n % 50, F.lit("missing_time"), n % 3).alias("reject_reasons"),
    )


def source_recovery_issues(spark, d):
    return probes.recovery_issues(_diagnosed(spark, d)).groupBy("issue_type", "why").agg(F.count(F.lit(1)).alias("n"), F.min("source_id").alias("first"))


def source_navigation_requests(spark, d):
    return probes.navigation_requests(_diagnosed(spark, d), 20).select("source_id", "need_score", "rank")


def social_heat_relevance_summary(spark, d):
    e = _t(spark, d, "events")
    checks = e.select(
        F.when(F.col("value") > 10, "off_topic").when(F.col("value") > 5, "relevant").alias("deterministic_status"), F.when(F.col("event_id") % 3 == 0, "within").otherwise("outside").alias("time_hint_status"),
        F.col("event_type").alias("result_type"), (F.col("value") < 1).alias("requires_semantic_review"),
    )
    return probes.relevance_summary(checks)


def semantic_relevance_requests(spark, d):
    checks = _t(spark, d, "events").withColumn("requires_semantic_review", F.col("value") < 1)
    return probes.semantic_requests(checks, "event_id", 15).select("request_id", "event_id")


def html_document_times(spark, d):
    """The time of a page from its meta elements; pages here name it in one of the keys that are read, or in one that is not."""
    from newsloom.functions.python import parse_page

    key = F.element_at(F.array(*(F.lit(k) for k in ("article:published_time", "date", "pubdate", "other"))), (F.col("page_id") % 4 + 1).cast("int"))
    page = F.concat(F.lit('<html><head><meta name="'), key, F.lit('" content="2024-01-0'), (F.col("page_id") % 9 + 1).cast("string"), F.lit('T00:00:00Z"><title>T '), F.col("page_id").cast("string"), F.lit("</title></head><body><p>x</p></body></html>"))
    p = _t(spark, d, "pages").select("page_id", "url", page.alias("html")).withColumn("p", parse_page("url", "html"))
    return p.select("page_id", F.col("p.title").alias("title"), F.coalesce("p.published", F.lit("")).alias("published"), F.col("p.content").alias("content"))


def _told_stories(spark, d):
    """Customers as stories: their names and segments, sources among the pages."""
    n = F.col("c_custkey")
    pick = lambda *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (n % len(xs) + 1).cast("int"))
    return _t(spark, d, "customer").select(
        n.alias("story_id"), F.concat("c_name", pick(" on xbox", " zelda patch", " steam and sony", "")).alias("title"), pick("", "nintendo released", "", "", "switch").alias("summary"), pick("", "pc", "nowhere").alias("theme_section"),
        pick("ready", "rejected", "ready", "draft").alias("status"), pick("verified", "rumor", "likely", "unheard", "credible_rumor").alias("internal_status"), (n % 100).cast("double").alias("story_score"),
        F.array(F.concat(F.lit("u"), (n % 70).cast("string")), F.concat(F.lit("u"), (n % 11).cast("string"))).alias("source_urls"),
    )


def story_sections(spark, d):
    s = _told_stories(spark, d)
    section = newsroom.story_section(F.col("title"), F.concat_ws(" ", "title", "summary"), F.col("theme_section"))
    return s.groupBy(section.alias("section")).agg(F.count(F.lit(1)).alias("n"))


def candidate_theme_sections(spark, d):
    s = _told_stories(spark, d)
    entry = F.when(F.col("story_id") % 4 == 0, F.array(F.lit("sony"), F.lit("mars"), F.lit("pc"))).otherwise(F.array().cast("array<string>"))
    found = newsroom.theme_sections(F.col("theme_section"), entry, F.when(F.col("story_id") % 7 == 0, "pc"), F.when(F.col("story_id") % 2 == 0, "nintendo"), F.lit("supplemental"))
    return s.groupBy(F.array_join(found, ",").alias("sections")).agg(F.count(F.lit(1)).alias("n"))


def _assets(spark, d):
    p = _t(spark, d, "pages")
    return p.select(F.concat(F.lit("u"), (F.col("page_id") % 90).cast("string")).alias("source_url"), F.concat(F.lit("img"), (F.col("page_id") % 130).cast("string")).alias("url"), F.when(F.col("page_id") % 3 == 0, "available").otherwise("pending").alias("status"), F.col("page_id").alias("asset_no"))


def story_assets(spark, d):
    return newsroom.story_assets(_told_stories(spark, d), _assets(spark, d)).drop("asset_no")


def platform_posts(spark, d):
    p = newsroom.platform_posts(_told_stories(spark, d), _assets(spark, d))
    return p.select("story_id", "title", "publish_status", "public_label_text", "asset_status")


def historical_context(spark, d):
    """Orders as past items of a few games; stories of a hundred customers."""
    pick = lambda *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.col("o_orderkey") % len(xs) + 1).cast("int"))
    past = _t(spark, d, "orders").select(F.col("o_orderkey").alias("past_id"), pick("zelda delayed", "a halo patch", "steam sale", "nothing", "sony award").alias("title"), F.col("o_orderdate").cast("timestamp").alias("published_at"))
    return newsroom.historical_context(_told_stories(spark, d), past, 1998, 3)


def parsed_judgments(spark, d):
    n = F.col("event_id")
    good = F.concat(F.lit('{"game_relevance": "'), F.when(n % 3 == 0, "core_game_news").otherwise("strange"), F.lit('", "publishability": "publishable", "heat_validity": "game_discussion", "confidence": '), F.round("value", 2).cast("string"), F.lit("}"))
    raw = F.when(n % 5 == 0, F.lit("no json")).when(n % 5 == 1, F.concat(F.lit("```json\n"), F.replace(good, F.lit("}"), F.lit(",}")), F.lit("\n```"))).when(n % 5 == 2, F.lit('{"reason": "x", "publishability": "publishable"}')).otherwise(good)
    j = newsroom.parsed_judgments(_t(spark, d, "events").select("event_id", raw.alias("raw_response")))
    return j.select("event_id", "parse_status", "game_relevance", "publishability", "heat_validity", F.round("confidence", 4).alias("confidence"))


def story_reviews(spark, d):
    r = _t(spark, d, "events").select(F.col("event_id").alias("review_id"), F.col("user_id").alias("story_id"), F.col("event_type").alias("decision"), F.col("ts").alias("created_at"))
    return newsroom.latest_decisions(r)


def artifacts_by_stage(spark, d):
    a = _t(spark, d, "part").select(F.concat(F.lit("file"), (F.col("p_partkey") % 9).cast("string")).alias("file_name"))
    out = newsroom.artifacts_by_stage(a, {"collect": ["file1", "file2", "file77"], "verify": ["file3"], "render": ["file99"]})
    return out.withColumn("missing", F.array_join("missing", ","))


def notification_issues(spark, d):
    n = F.col("event_id")
    rows = _t(spark, d, "events").select(
        F.when(n % 4 > 0, F.concat(F.lit("notif_"), F.substring(F.sha1(n.cast("string").cast("binary")), 1, 12))).otherwise(F.lit("nid")).alias("notification_id"), F.when(n % 5 > 0, "RUN-006").otherwise("run6").alias("issue_id"),
        F.when(n % 7 > 0, "collect").otherwise(" ").alias("stage"), F.when(n % 3 > 0, "warning").otherwise("odd").alias("severity"), F.when(n % 11 > 0, "open").alias("status"), F.col("event_type").alias("title"), F.lit("m").alias("message"),
    )
    return newsroom.notification_issues(rows).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def search_event_context(spark, d):
    """Two rows of one context each: of all orders as candidates, and of those without an event's name."""
    o = _t(spark, d, "orders")
    words = F.when(F.col("o_orderkey") % 9 == 4, "gamescom demo").when(F.col("o_orderkey") % 9 == 2, "a showcase revealed").otherwise("nothing")
    c = o.select(F.col("o_orderkey").alias("ordinal"), words.alias("title"), F.lit("").alias("snippet"), F.lit("").alias("query"))
    return requests.event_context(c, "ordinal").withColumn("of", F.lit("all")).unionByName(requests.event_context(c.where("title = 'nothing'"), "ordinal").withColumn("of", F.lit("plain")))


def _expansions(spark, d):
    n = F.col("p_partkey")
    pick = lambda *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (n % len(xs) + 1).cast("int"))
    return _t(spark, d, "part").select(n.alias("request_no"), F.concat(F.lit("r"), n.cast("string")).alias("request_id"), pick("theme_gap", "event_burst", "candidate_followup").alias("method"), F.concat(F.lit("query "), n.cast("string")).alias("query"))


def query_compression_requests(spark, d):
    return requests.compression_requests(_expansions(spark, d), 40)


def compressed_queries_applied(spark, d):
    n = F.col("s_suppkey")
    raw = F.when(n % 3 == 0, F.lit("nothing")).when(n % 3 == 1, F.concat(F.lit('{"queries": [" ", "short '), n.cast("string"), F.lit('"], "confidence": 7}'))).otherwise(F.lit('{"queries": []}'))
    answers = _t(spark, d, "supplier").select(F.concat(F.lit("query-compression-r"), n.cast("string")).alias("request_id"), raw.alias("raw_response"))
    return requests.with_compressed_queries(_expansions(spark, d), answers).groupBy("query_source").agg(F.count(F.lit(1)).alias("n"), F.min("query").alias("first"))


def result_relevance_applied(spark, d):
    e = _t(spark, d, "events").select((F.col("user_id") % 20).alias("request_id"), F.col("event_type").alias("platform"), F.concat(F.lit("u"), (F.col("event_id") % 50).cast("string")).alias("url"), "event_id", "value")
    made = e.where("event_id % 4 = 0").select("request_id", "platform", "url", F.col("event_id").alias("decision_no"), F.when(F.col("value") > 6, "reject").otherwise("same_game").alias("relevance"))
    return requests.with_relevance(e, made).groupBy("platform", "llm_relevance", "llm_rejected").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        context_packs, claims_from_packs, claims_verified, evidence_with_filters, fact_inference_split, story_event_types, story_events, event_news_links, news_game_links, game_event_timeline, source_theme_counts,
        collector_diagnostics, source_selection_diagnostics, source_health_warnings, fallback_warnings,
        discussion_probe_requests, discussion_probes_applied, editorial_judgment_requests, source_recovery_issues, source_navigation_requests, social_heat_relevance_summary, semantic_relevance_requests, html_document_times,
        story_sections, candidate_theme_sections, story_assets, platform_posts, historical_context, parsed_judgments, story_reviews, artifacts_by_stage, notification_issues,
        search_event_context, query_compression_requests, compressed_queries_applied, result_relevance_applied,
    )
}

_P = f"""cand AS (SELECT page_id AS candidate_id, CASE WHEN page_id % 7 = 3 THEN '' ELSE {_HTML_TITLE} END AS title, CASE WHEN page_id % 3 = 0 THEN regexp_extract(html, '<p>([^<]*)<', 1) ELSE '' END AS query, url,
  regexp_extract(url, '^[^:]*://([^/]*)', 1) AS source_id, ['news', 'rumor', 'guide', 'fact', 'discussion_search_lead'][page_id % 5 + 1] AS candidate_type, page_id % 4 = 1 AS untimed FROM pages),
chunk AS (SELECT page_id AS chunk_id, url, {_HTML_TITLE} AS title, regexp_extract(html, '<p>([^<]*)<', 1) AS quote, regexp_extract(url, '^[^:]*://([^/]*)', 1) AS source_id, page_id % 3 AS third FROM pages WHERE page_id % 2 = 0),
same AS (SELECT candidate_id, c.chunk_id, row_number() OVER (PARTITION BY candidate_id ORDER BY chunk_id) AS rank FROM cand JOIN chunk c USING (url) QUALIFY rank <= 5),
lone AS (SELECT candidate_id, list_distinct({_words("trim(title || ' ' || query)", _STOP)}) AS ws FROM cand WHERE candidate_id NOT IN (SELECT candidate_id FROM same)),
hit AS (SELECT candidate_id, chunk_id, len(list_filter(ws, lambda t: contains(lower(title || ' ' || quote || ' ' || url), t))) AS score FROM lone, chunk),
other AS (SELECT candidate_id, chunk_id, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, chunk_id DESC) AS rank FROM hit WHERE score > 0 QUALIFY rank <= 5),
ev AS (SELECT *, true AS own FROM same UNION ALL SELECT *, false FROM other),
pack AS (SELECT c.*, list({{'chunk_id': e.chunk_id, 'title': k.title, 'quote': k.quote, 'url': k.url}} ORDER BY rank) FILTER (e.chunk_id IS NOT NULL) AS evidence, bool_or(own) AS own FROM cand c LEFT JOIN ev e USING (candidate_id) LEFT JOIN chunk k ON k.chunk_id = e.chunk_id GROUP BY ALL)"""
_SCOPE = "CASE WHEN own THEN 'candidate_url' WHEN evidence IS NOT NULL THEN 'retrieved_context' ELSE 'none' END"
CONTEXT_PACKS = f"""WITH {_P} SELECT candidate_id, {_SCOPE} AS evidence_scope, coalesce(len(evidence), 0) AS n_evidence, coalesce(array_to_string(list_transform(evidence, lambda e: e.chunk_id::VARCHAR), ','), '') AS chunks,
 array_to_string(list_filter([CASE WHEN evidence IS NULL THEN 'evidence' WHEN NOT own THEN 'source_document' END, CASE WHEN untimed THEN 'time' END], lambda x: x IS NOT NULL), ',') AS missing FROM pack"""
_CUT = lambda x: f"trim(string_split(trim(string_split(trim(regexp_replace({x}, '\\s+', ' ', 'g')), ' _ ')[1]), ' | ')[1])"
_C = f"""titled AS (SELECT *, trim(title) AS t, coalesce(list_transform(evidence, lambda e: {_CUT('e.title')}), []) AS ts, coalesce(list_transform(evidence, lambda e: CASE WHEN {_CUT('e.title')} <> '' THEN {_CUT('e.title')} ELSE substr(trim(e.quote), 1, 180) END), []) AS lines FROM pack),
claim AS (SELECT candidate_id AS claim_id, own, evidence, url, source_id, candidate_type, CASE WHEN t <> '' THEN
   CASE WHEN length(regexp_replace(t, '\\s', '', 'g')) < 8 OR (regexp_full_match(regexp_replace(t, '\\s', '', 'g'), '[A-Za-z0-9]+') AND length(regexp_replace(t, '\\s', '', 'g')) < 12)
     THEN coalesce(list_filter(ts, lambda x: x <> '' AND length(x) > length(t) AND contains(lower(x), lower(t)))[1], t) ELSE t END
   ELSE coalesce(list_filter(lines, lambda x: x <> '')[1], 'Untitled claim') END AS text FROM titled)"""
CLAIMS = f"""WITH {_P}, {_C} SELECT claim_id, text, 'story_' || substr(sha1(url), 1, 12) AS story_id, CASE candidate_type WHEN 'discussion_search_lead' THEN 'search_lead' WHEN 'guide' THEN 'supplemental_context' WHEN 'fact' THEN 'fact_candidate' ELSE candidate_type END AS claim_type,
 CASE WHEN evidence IS NULL THEN 'needs_evidence' ELSE 'candidate_claim' END AS extraction_status, trim(url) AS urls, CASE WHEN own THEN array_to_string(list_transform(evidence, lambda e: e.chunk_id::VARCHAR), ',') ELSE '' END AS chunks FROM claim"""
VERIFIED = f"""WITH {_P}, {_C}, s AS (SELECT claim_id, candidate_type AS ct, list_distinct({_words('text', _CLAIM_STOP)}) AS ws, text, count(k.chunk_id) AS n, lower(coalesce(string_agg(k.quote, ' '), '')) AS low FROM claim c LEFT JOIN chunk k ON k.url = c.url GROUP BY claim_id, candidate_type, text),
x AS (SELECT *, CASE WHEN len(ws) = 0 OR n = 0 THEN 0.0 ELSE len(list_filter(ws, lambda t: contains(low, t))) / len(ws) END AS sup FROM s)
SELECT claim_id, n AS n_evidence, round(sup, 3) AS support_score, CASE WHEN n = 0 OR ct IN ('guide', 'discussion_search_lead') THEN 'reject' WHEN ct = 'rumor' THEN 'rumor' WHEN sup >= 0.45 OR (ct = 'news' AND sup >= 0.25) THEN 'likely' ELSE 'reject' END AS check_status,
 round(CASE WHEN n = 0 THEN 0.0 WHEN ct IN ('guide', 'discussion_search_lead') THEN 0.1 WHEN ct = 'rumor' THEN 0.35 + sup * 0.25 WHEN sup >= 0.45 THEN 0.45 + sup * 0.35 WHEN ct = 'news' AND sup >= 0.25 THEN 0.38 + sup * 0.28 ELSE 0.1 END, 2) AS confidence,
 CASE WHEN n = 0 THEN 'missing_evidence' WHEN ct = 'guide' THEN 'supplemental_context_not_publishable' WHEN ct = 'discussion_search_lead' THEN 'search_lead_requires_confirmation' WHEN ct = 'rumor' THEN 'rumor_claim_with_evidence' WHEN sup >= 0.45 THEN 'supporting_evidence_overlap'
  WHEN ct = 'news' AND sup >= 0.25 THEN 'partial_supporting_evidence_overlap' ELSE 'weak_or_unmatched_evidence' END AS verification_reason FROM x"""
FILTERED = f"""WITH {_P}, d AS (SELECT chunk_id, {_words("title || ' ' || quote", _STOP)} AS w FROM chunk), stats AS (SELECT count(*) AS n, greatest(avg(len(w)), 1.0) AS avgdl FROM d),
p AS (SELECT chunk_id, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(w) AS dl, unnest(w) AS token FROM d) GROUP BY 1, 2), f AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT item_id, unnest(list_distinct({_words('text', _STOP)})) AS token FROM benchmark),
s AS (SELECT item_id, chunk_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN p USING (token) JOIN f USING (token), stats GROUP BY 1, 2),
b AS (SELECT item_id, chunk_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s WHERE score > 0 AND chunk_id % 3 = 0 AND chunk_id >= 20 QUALIFY rank <= 5),
rest AS (SELECT item_id, list_distinct({_words('text', _STOP)}) AS ws FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM b)),
k AS (SELECT item_id, chunk_id, len(list_filter(ws, lambda t: contains(lower(title || ' ' || quote || ' ' || url), t)))::DOUBLE AS score FROM rest, chunk),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id DESC) AS rank FROM k WHERE score > 0 QUALIFY rank <= 5)
SELECT item_id, 'bm25' AS retriever, chunk_id, round(score, 6) AS score, rank FROM b UNION ALL SELECT item_id, 'keyword', chunk_id, score, rank FROM r"""
FACTS = """WITH x AS (SELECT c_custkey, c_custkey % 3 AS k, c_mktsegment AS a, c_name AS b FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN a || ' announced a price increase' WHEN 1 THEN a ELSE a || ' and ' || b END AS factual_part, CASE k WHEN 0 THEN 'due to costs of ' || b WHEN 1 THEN '因为 ' || b ELSE '' END AS inference_part,
 CASE k WHEN 0 THEN 0.9 WHEN 1 THEN CASE WHEN length(a) >= 10 THEN 0.75 ELSE 0.5 END ELSE 0.9 END::DOUBLE AS fact_confidence, CASE WHEN k = 2 THEN 0.0 ELSE 0.7 END::DOUBLE AS inference_confidence, CASE k WHEN 0 THEN 'due to' WHEN 1 THEN '因为' ELSE '' END AS split_marker, k < 2 AS is_separable FROM x"""
TYPES = """SELECT CASE WHEN o_orderkey % 4 = 1 THEN 'leak_or_rumor' WHEN o_orderkey % 4 = 0 THEN 'patch_or_update' WHEN o_orderkey % 5 = 0 THEN 'review_or_score' ELSE 'general_news' END AS event_type,
 CASE WHEN o_orderkey % 4 IN (0, 1) THEN 'update' ELSE 'general' END AS history, count(*) AS n FROM orders GROUP BY 1, 2"""
_E = f"""story AS (SELECT o_orderkey AS ordinal, 'story ' || (o_orderkey % 500) AS title, ['announcement', 'rumor', 'other'][o_orderkey % 3 + 1] AS event_type, CASE WHEN o_orderkey % 7 = 0 THEN 'new_detail' ELSE 'primary_event' END AS role,
  lower(CASE WHEN o_orderkey % 5 > 0 THEN 'Game ' || (o_custkey % 50) ELSE 'story ' || (o_orderkey % 500) END) AS game, least(o_totalprice / 5000, 100.0) / 100 AS confidence, o_orderdate AS started_at, {_canon('url')} AS u
  FROM orders JOIN pages ON page_id = o_orderkey % (SELECT count(*) FROM pages) WHERE o_orderkey % 4 = 0),
keyed AS (SELECT *, 'g_' || substr(sha1(game), 1, 12) AS game_id, 'ev_' || substr(sha1(title || '|' || event_type || '|g_' || substr(sha1(game), 1, 12)), 1, 12) AS event_id, 'ni_' || substr(sha1(u), 1, 12) AS news_item_id FROM story),
event AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ordinal DESC) = 1),
item AS (SELECT 'ni_' || substr(sha1(u), 1, 12) AS news_item_id, min(page_id) AS page_id FROM (SELECT {_canon('url')} AS u, page_id FROM pages WHERE page_id % 3 > 0) GROUP BY u),
link AS (SELECT event_id, news_item_id, game_id, role, confidence FROM keyed JOIN item USING (news_item_id) QUALIFY row_number() OVER (PARTITION BY event_id, news_item_id ORDER BY ordinal DESC) = 1)"""
EVENTS = f"WITH {_E} SELECT event_id, title, event_type, game_id, strftime(started_at, '%Y-%m-%d') AS started FROM event"
LINKS = f"WITH {_E} SELECT event_id, news_item_id, game_id, role, confidence FROM link"
GAME_LINKS = f"WITH {_E} SELECT news_item_id, game_id, 'keyword_match' AS match_method, max(confidence) AS confidence FROM link GROUP BY 1, 2"
EVENT_NEWS = f"""WITH {_E} SELECT event_id, strftime(started_at, '%Y-%m-%d') AS started, coalesce(string_agg('page ' || page_id, ',' ORDER BY page_id), '') AS news FROM event LEFT JOIN (SELECT event_id, page_id FROM link JOIN item USING (news_item_id)) USING (event_id)
WHERE started_at >= TIMESTAMP '1998-08-03' - INTERVAL 900 DAY GROUP BY event_id, started_at"""
_SECTIONS = reports.SECTIONS
_S = """e AS (SELECT user_id::VARCHAR AS source_id, event_type AS t, event_id AS i, value AS v, ['sony', 'nintendo', 'microsoft', 'pc', 'supplemental'][event_id % 5 + 1] AS s, CASE WHEN value > 10 THEN 'outside_time_window' WHEN value > 5 THEN 'missing_time' ELSE 'unknown' END AS why FROM events)"""
_TC = f"""tc AS (SELECT source_id, count(*) FILTER (t = 'view') AS raw_fetch_count, count(*) AS raw_candidate_count, count(*) FILTER (t = 'purchase') AS main_count, count(*) FILTER (t = 'signup') AS supplemental_count,
 count(*) FILTER (t IN ('purchase', 'signup')) AS accepted_count, count(*) FILTER (t = 'error') AS rejected_count, {", ".join(f"count(*) FILTER (t IN ('purchase', 'signup') AND s = '{x}') AS theme_{x}, count(*) FILTER (t = 'purchase' AND s = '{x}') AS main_{x}" for x in _SECTIONS)} FROM e GROUP BY 1)"""
THEMES = f"""WITH {_S}, {_TC}, r AS (SELECT source_id, string_agg(why || '=' || n, ',' ORDER BY why) AS reject_reasons FROM (SELECT source_id, why, count(*) AS n FROM e WHERE t = 'error' GROUP BY 1, 2) GROUP BY 1)
SELECT tc.*, coalesce(reject_reasons, '') AS reject_reasons FROM tc LEFT JOIN r USING (source_id)"""
COLLECTORS = f"""WITH {_S} SELECT s_suppkey::VARCHAR AS source_id, s_name AS name, count(*) FILTER (t = 'view') AS raw_fetch_count, count(*) FILTER (t = 'click') AS entry_count, count(*) FILTER (t = 'purchase') AS candidate_count,
 count(*) FILTER (t = 'purchase' AND i % 3 = 0) AS candidate_missing_time_count, count(*) FILTER (t = 'error' AND why = 'missing_time') AS rejected_missing_time_count, count(*) FILTER (t = 'signup') AS error_count,
 coalesce(sum(3) FILTER (t = 'click'), 0)::BIGINT AS link_count, coalesce(sum(i % 2) FILTER (t = 'click'), 0)::BIGINT AS duplicate_url_count, coalesce(sum(i % 5) FILTER (t = 'click'), 0)::BIGINT AS parse_warning_count,
 count(*) FILTER (t = 'purchase' AND i % 3 = 0) + count(*) FILTER (t = 'error' AND why = 'missing_time') AS missing_time_count FROM supplier LEFT JOIN e ON source_id = s_suppkey::VARCHAR GROUP BY 1, 2"""
SELECTION = f"""WITH {_S}, n AS (SELECT source_id, count(*) AS raw_candidates, count(*) FILTER (t = 'purchase') AS main_candidates, count(*) FILTER (t = 'signup') AS supplemental_candidates, count(*) FILTER (t IN ('purchase', 'signup')) AS accepted_candidates,
 count(*) FILTER (t = 'error') AS rejected_candidates, count(*) FILTER (t = 'purchase') AS theme_pool_selected, count(*) FILTER (t = 'purchase' AND i % 2 = 0) AS document_fetch_selected, count(*) FILTER (t = 'error' AND v > 15) AS document_errors,
 count(*) FILTER (t = 'purchase' AND i % 4 = 0) AS story_candidates, count(*) FILTER (t = 'purchase' AND i % 8 = 0) AS final_stories, count(*) FILTER (t = 'purchase' AND i % 2 = 0) AS own_evidence,
 count(*) FILTER (t = 'purchase' AND i % 2 > 0 AND i % 3 = 0) AS retrieved_evidence, count(*) FILTER (t = 'purchase' AND i % 2 > 0 AND i % 3 > 0) AS no_evidence, count(*) FILTER (t = 'purchase' AND i % 4 = 0) AS missing_time FROM e GROUP BY 1)
SELECT *, array_to_string(list_filter([CASE WHEN accepted_candidates > 0 AND theme_pool_selected < accepted_candidates THEN 'theme_pool_competition' END, CASE WHEN theme_pool_selected > 0 AND document_fetch_selected < theme_pool_selected THEN 'document_fetch_budget_competition' END,
 CASE WHEN document_fetch_selected > 0 AND story_candidates < document_fetch_selected THEN 'claim_or_evidence_gate' END, CASE WHEN story_candidates > 0 AND final_stories < story_candidates THEN 'story_score_competition' END,
 CASE WHEN accepted_candidates = 0 THEN 'no_accepted_candidates' END], lambda x: x IS NOT NULL), ',') AS diagnostic_reasons FROM n"""
WARNINGS = """WITH h AS (SELECT user_id::VARCHAR AS source_id, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'purchase') AS c FROM events GROUP BY 1)
SELECT source_id, 'RUN-006' AS issue_id, 'search_candidates' AS stage, 'warning' AS severity, CASE WHEN e > 12 THEN 'Source broken: ' ELSE 'Source needs fill: ' END || source_id AS title,
 CASE WHEN e > 12 THEN source_id || ' is broken after ' || e || ' errors' ELSE source_id || ' gave ' || c || ' candidates in the window' END AS message FROM h WHERE c < 14"""
FALLBACK = """WITH r AS (SELECT event_type || '_' || (user_id % 20) AS task_type, value > 6 AS bad FROM events), s AS (SELECT task_type, count(*) AS total, count(*) FILTER (bad) AS problem_count FROM r GROUP BY 1)
SELECT task_type, total, problem_count, round(problem_count / total, 3) AS problem_rate, 'warning' AS severity FROM s WHERE problem_count / total >= 0.4"""

_PC = """pc AS (SELECT conv_id AS o, 'Topic  ' || (conv_id % 90) || [' | IGN news', ' - report', ''][conv_id % 3 + 1] AS title, CASE WHEN conv_id % 6 > 0 THEN 'https://example.com/' || (conv_id % 120) END AS url, ['ign', 'bilibili', 'other'][conv_id % 3 + 1] AS source_id,
  ['news', 'guide', 'general_tech', 'manual_review'][conv_id % 4 + 1] AS kind, conv_id % 2 AS lane, (conv_id % 40)::DOUBLE AS score FROM conversations WHERE turn = 0)"""
PROBE_REQUESTS = f"""WITH {_PC}, k AS (SELECT *, coalesce(url, trim(title)) AS key FROM pc QUALIFY row_number() OVER (PARTITION BY key ORDER BY o) = 1)
SELECT row_number() OVER (ORDER BY o) AS request_no, url AS candidate_url, trim(regexp_replace(trim(regexp_replace(title, '\\s+', ' ', 'g')), '\\s*[|_-]\\s*(IGN|GameSpot|PC Gamer).*$', '', 'i')) AS query,
 CASE source_id WHEN 'ign' THEN 'en_global' WHEN 'bilibili' THEN 'zh_cn' ELSE 'global' END AS heat_region FROM k QUALIFY request_no <= 25"""
PROBES_APPLIED = f"""WITH {_PC}, r AS (SELECT 'https://example.com/' || (page_id % 120) AS u, arg_max(page_id, page_id) AS p FROM pages WHERE page_id % 2 = 1 GROUP BY 1),
j AS (SELECT o, score, p, (p % 80)::DOUBLE AS s FROM pc LEFT JOIN r ON url = u), b AS (SELECT *, p IS NOT NULL AND (p % 5 = 0 OR s >= 35) AND s > score AS better FROM j)
SELECT o AS ordinal, CASE WHEN p IS NULL THEN NULL WHEN better THEN 'promoted' ELSE 'kept_existing' END AS discussion_probe_status, CASE WHEN better THEN s ELSE score END AS discussion_score,
 CASE WHEN better THEN CASE WHEN s >= 70 THEN 'trending' WHEN s >= 35 THEN 'discussed' ELSE 'weak' END ELSE 'weak' END AS discussion_level FROM b"""
JUDGMENT = f"""WITH {_PC}, r AS (SELECT o, url, title, array_to_string(list_filter([CASE WHEN kind IN ('general_tech', 'manual_review') THEN 'ambiguous_candidate_type:' || kind END, CASE WHEN lane = 1 THEN 'supplemental_lane' END,
  CASE WHEN score >= 25 AND kind <> 'news' THEN 'social_heat_needs_game_relevance_check' END], lambda x: x IS NOT NULL), ',') AS reasons FROM pc),
u AS (SELECT * FROM r WHERE reasons <> '' QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(url, ''), title) ORDER BY o) = 1),
n AS (SELECT *, row_number() OVER (ORDER BY o) AS request_no FROM u QUALIFY request_no <= 30)
SELECT 'editorial_judgment_' || substr(sha1(coalesce(url, '') || '|' || title || '|' || o), 1, 10) AS request_id, o AS ordinal, request_no, reasons FROM n"""
_DG = """dg AS (SELECT p_partkey AS n, p_partkey % 13 AS c, p_partkey % 2 AS raw, p_partkey % 4 AS e, p_partkey % 200 AS l, p_partkey % 7 AS mt, p_partkey % 6 AS du, p_partkey % 50 AS ir, p_partkey % 3 AS mr, p_partkey % 5 AS rm, p_partkey % 9 AS pw,
  [5, 3, 8][p_partkey % 3 + 1] AS least FROM part)"""
RECOVERY = f"""WITH {_DG}, i AS (SELECT n, 'entry_broken' AS issue_type, 'errors_without_candidates' AS why FROM dg WHERE e >= 2 AND c = 0 UNION ALL SELECT n, 'network_persistent', 'source_blocked' FROM dg WHERE n % 4 = 3
 UNION ALL SELECT n, 'low_count', 'below_expected' FROM dg WHERE c > 0 AND c < least UNION ALL SELECT n, 'low_count', 'no_candidates' FROM dg WHERE c = 0 AND e < 2 AND raw > 0
 UNION ALL SELECT n, 'structure_change', 'few_links_accepted' FROM dg WHERE l > 0 AND c > 0 AND c / l < 0.1 UNION ALL SELECT n, 'structure_change', 'irrelevant_rejects' FROM dg WHERE ir >= greatest(3 * c, 10)
 UNION ALL SELECT n, 'missing_timestamps', 'missing_time_ratio' FROM dg WHERE mt / greatest(c + mr, 1) >= 0.3 UNION ALL SELECT n, 'structure_change', 'duplicate_urls' FROM dg WHERE c > 0 AND du / c >= 0.5)
SELECT issue_type, why, count(*) AS n, min(n::VARCHAR) AS first FROM i GROUP BY 1, 2"""
NAVIGATION = f"""WITH {_DG}, s AS (SELECT n::VARCHAR AS source_id, round(CASE WHEN c = 0 THEN 80.0 WHEN c < 5 THEN 30.0 WHEN c < 10 THEN 10.0 ELSE 0.0 END + e * 20.0 + pw * 8.0 + mt * 4.0 + rm * 4.0 + du + mr * 3.0 + ir * 5.0, 2)::DOUBLE AS need_score FROM dg)
SELECT source_id, need_score, row_number() OVER (ORDER BY need_score DESC, source_id) AS rank FROM s WHERE need_score > 0 QUALIFY rank <= 20"""
RELEVANCE = """WITH c AS (SELECT CASE WHEN value > 10 THEN 'off_topic' WHEN value > 5 THEN 'relevant' ELSE 'unknown' END AS s, CASE WHEN event_id % 3 = 0 THEN 'within' ELSE 'outside' END AS t, event_type AS r, (value < 1)::VARCHAR AS q FROM events),
r AS (SELECT 'status' AS kind, s AS value FROM c UNION ALL SELECT 'time_hint', t FROM c UNION ALL SELECT 'result_type', r FROM c UNION ALL SELECT 'semantic_review', q FROM c) SELECT kind, value, count(*) AS n FROM r GROUP BY 1, 2"""
SEMANTIC = "SELECT 'semantic_relevance_' || row_number() OVER (ORDER BY event_id) AS request_id, event_id FROM events WHERE value < 1 ORDER BY event_id LIMIT 15"
PAGE_TIMES = "SELECT page_id, 'T ' || page_id AS title, CASE WHEN page_id % 4 < 3 THEN '2024-01-0' || (page_id % 9 + 1) || 'T00:00:00Z' ELSE '' END AS published, 'x' AS content FROM pages"

_TS = """ts AS (SELECT c_custkey AS id, c_name || [' on xbox', ' zelda patch', ' steam and sony', ''][c_custkey % 4 + 1] AS title, ['', 'nintendo released', '', '', 'switch'][c_custkey % 5 + 1] AS summary, ['', 'pc', 'nowhere'][c_custkey % 3 + 1] AS given,
  ['ready', 'rejected', 'ready', 'draft'][c_custkey % 4 + 1] AS status, ['verified', 'rumor', 'likely', 'unheard', 'credible_rumor'][c_custkey % 5 + 1] AS internal FROM customer)"""
STORY_SECTIONS = f"""WITH {_TS}, x AS (SELECT given, id % 4 AS k, id % 5 IN (1, 4) AS nin FROM ts)
SELECT CASE WHEN given = 'pc' THEN 'pc' WHEN k = 0 THEN 'microsoft' WHEN k = 1 THEN 'nintendo' WHEN k = 2 THEN 'sony' WHEN nin THEN 'nintendo' ELSE 'supplemental' END AS section, count(*) AS n FROM x GROUP BY 1"""
THEME_SECTIONS = f"""WITH {_TS}, x AS (SELECT given, list_distinct([]::VARCHAR[]) AS e, CASE WHEN id % 4 = 0 THEN 'sony,pc' WHEN id % 7 = 0 AND id % 2 = 0 THEN 'pc,nintendo' WHEN id % 7 = 0 THEN 'pc' WHEN id % 2 = 0 THEN 'nintendo' ELSE 'supplemental' END AS f, id FROM ts)
SELECT CASE WHEN given = 'pc' THEN 'pc' WHEN id % 4 = 0 THEN 'sony,pc,nintendo' ELSE f END AS sections, count(*) AS n FROM x GROUP BY 1"""
_AS = """a AS (SELECT 'u' || (page_id % 90) AS source_url, 'img' || (page_id % 130) AS url, CASE WHEN page_id % 3 = 0 THEN 'available' ELSE 'pending' END AS status, page_id AS no FROM pages),
su AS (SELECT DISTINCT c_custkey AS story_id, unnest(['u' || (c_custkey % 70), 'u' || (c_custkey % 11)]) AS source_url FROM customer),
sa AS (SELECT story_id, source_url, url, arg_min(status, no) AS status FROM su JOIN a USING (source_url) GROUP BY 1, 2, 3)"""
STORY_ASSETS = f"WITH {_AS} SELECT * FROM sa"
POSTS = f"""WITH {_TS}, {_AS} SELECT id AS story_id, title, CASE WHEN internal IN ('rumor', 'credible_rumor', 'unheard') THEN 'needs_review' ELSE status END AS publish_status,
 CASE internal WHEN 'verified' THEN '[已核实]' WHEN 'likely' THEN '[证据支持]' WHEN 'credible_rumor' THEN '[流言][可信爆料]' WHEN 'rumor' THEN '[流言][未验证]' ELSE '[待核查]' END AS public_label_text,
 CASE WHEN id IN (SELECT story_id FROM sa WHERE status = 'available') THEN 'available' ELSE 'manual_fill_required' END AS asset_status FROM ts WHERE status <> 'rejected'"""
HISTORY = f"""WITH {_TS}, p AS (SELECT o_orderkey AS past_id, o_orderdate AS day, [['zelda', 'delay'], ['halo', 'update'], ['steam'], []::VARCHAR[], ['sony', 'award']][o_orderkey % 5 + 1] AS k FROM orders WHERE year(o_orderdate) >= 1995),
w AS (SELECT id, list_filter([CASE WHEN id % 4 = 0 THEN 'xbox' END, CASE WHEN id % 4 = 1 THEN 'zelda' END, CASE WHEN id % 4 = 1 THEN 'update' END, CASE WHEN id % 4 = 2 THEN 'steam' END, CASE WHEN id % 4 = 2 THEN 'sony' END], lambda x: x IS NOT NULL) AS k FROM ts),
q AS (SELECT DISTINCT id, past_id, day FROM (SELECT id, unnest(k) AS k FROM w) JOIN (SELECT past_id, day, unnest(k) AS k FROM p) USING (k))
SELECT id AS story_id, past_id, row_number() OVER (PARTITION BY id ORDER BY day DESC, past_id) AS rank FROM q QUALIFY rank <= 8"""
JUDGMENTS = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'ok_repaired' WHEN 2 THEN 'fallback_inconsistent' ELSE 'ok' END AS parse_status,
 CASE WHEN event_id % 5 IN (1, 3, 4) AND event_id % 3 = 0 THEN 'core_game_news' ELSE 'unknown' END AS game_relevance, CASE WHEN event_id % 5 IN (1, 3, 4) THEN 'publishable' ELSE 'needs_human_review' END AS publishability,
 CASE WHEN event_id % 5 IN (1, 3, 4) THEN 'game_discussion' ELSE 'unclear' END AS heat_validity, CASE WHEN event_id % 5 IN (1, 3, 4) THEN round(least(greatest(round(value, 2), 0.0), 1.0), 4) ELSE 0.0 END AS confidence FROM events"""
REVIEWS = "SELECT user_id AS story_id, arg_max(event_type, (ts, event_id)) AS decision, count(*) AS n_reviews FROM events GROUP BY 1"
STAGES = """WITH s AS (SELECT * FROM (VALUES ('collect', 'file1'), ('collect', 'file2'), ('collect', 'file77'), ('verify', 'file3'), ('render', 'file99')) v(stage, f)), a AS (SELECT DISTINCT 'file' || (p_partkey % 9) AS f FROM part)
SELECT stage, count(*)::INT AS expected, count(a.f) AS present, coalesce(string_agg(s.f, ',' ORDER BY s.f) FILTER (a.f IS NULL), '') AS missing FROM s LEFT JOIN a USING (f) GROUP BY stage
UNION ALL SELECT 'other', 0, count(*), '' FROM a WHERE f NOT IN (SELECT f FROM s) HAVING count(*) > 0"""
NOTES = """WITH x AS (SELECT CASE WHEN event_id % 4 = 0 THEN 'malformed:notification_id' END AS issue FROM events UNION ALL SELECT CASE WHEN event_id % 5 = 0 THEN 'malformed:issue_id' END FROM events UNION ALL SELECT CASE WHEN event_id % 7 = 0 THEN 'blank:stage' END FROM events
 UNION ALL SELECT CASE WHEN event_id % 3 = 0 THEN 'invalid:severity' END FROM events UNION ALL SELECT CASE WHEN event_id % 11 = 0 THEN 'missing:status' END FROM events) SELECT issue, count(*) AS n FROM x WHERE issue IS NOT NULL GROUP BY 1"""

CONTEXT = """SELECT 'all' AS of, true AS active, CASE WHEN bool_or(o_orderkey % 9 = 4) THEN 'gamescom' ELSE 'showcase' END AS event_name, 2 AS event_signal_count, 3 AS new_content_signal_count, 'event_burst' AS quota_policy FROM orders
UNION ALL SELECT 'plain', false, '', 0, 0, 'normal'"""
COMPRESSION = "SELECT 'query-compression-r' || p_partkey AS request_id, 'r' || p_partkey AS source_request_id, CASE WHEN p_partkey % 3 = 1 THEN 'event_burst' ELSE 'candidate_followup' END AS method, 'query ' || p_partkey AS fallback_query FROM part WHERE p_partkey % 3 > 0 ORDER BY p_partkey LIMIT 40"
COMPRESSED = """WITH j AS (SELECT p_partkey AS p, s_suppkey AS s FROM part LEFT JOIN supplier ON s_suppkey = p_partkey),
x AS (SELECT CASE WHEN s IS NULL THEN NULL WHEN s % 3 = 1 THEN 'llm_compressed' ELSE 'fallback' END AS query_source, CASE WHEN s % 3 = 1 THEN 'short ' || s ELSE 'query ' || p END AS q FROM j) SELECT query_source, count(*) AS n, min(q) AS first FROM x GROUP BY 1"""
RESULTS = """WITH e AS (SELECT user_id % 20 AS r, event_type AS platform, event_id % 50 AS u, event_id AS i, value AS v FROM events), d AS (SELECT r, platform, u, arg_max(CASE WHEN v > 6 THEN 'reject' ELSE 'same_game' END, i) AS llm_relevance FROM e WHERE i % 4 = 0 GROUP BY 1, 2, 3)
SELECT platform, llm_relevance, coalesce(llm_relevance = 'reject', false) AS llm_rejected, count(*) AS n FROM e LEFT JOIN d USING (r, platform, u) GROUP BY 1, 2, 3"""

ORACLE_SQL = {
    "context_packs": CONTEXT_PACKS, "claims_from_packs": CLAIMS, "claims_verified": VERIFIED, "evidence_with_filters": FILTERED, "fact_inference_split": FACTS, "story_event_types": TYPES, "story_events": EVENTS,
    "event_news_links": LINKS, "news_game_links": GAME_LINKS, "game_event_timeline": EVENT_NEWS, "source_theme_counts": THEMES, "collector_diagnostics": COLLECTORS, "source_selection_diagnostics": SELECTION,
    "source_health_warnings": WARNINGS, "fallback_warnings": FALLBACK, "discussion_probe_requests": PROBE_REQUESTS, "discussion_probes_applied": PROBES_APPLIED, "editorial_judgment_requests": JUDGMENT,
    "source_recovery_issues": RECOVERY, "source_navigation_requests": NAVIGATION, "social_heat_relevance_summary": RELEVANCE, "semantic_relevance_requests": SEMANTIC, "html_document_times": PAGE_TIMES, "story_sections": STORY_SECTIONS,
    "candidate_theme_sections": THEME_SECTIONS, "story_assets": STORY_ASSETS, "platform_posts": POSTS, "historical_context": HISTORY, "parsed_judgments": JUDGMENTS, "story_reviews": REVIEWS, "artifacts_by_stage": STAGES,
    "notification_issues": NOTES, "search_event_context": CONTEXT, "query_compression_requests": COMPRESSION, "compressed_queries_applied": COMPRESSED, "result_relevance_applied": RESULTS,
}
