"""From candidates to verified claims: context packs, claims, verification, fact and inference, filtered retrieval.

Candidates have candidate_id, title, snippet, query, url, source_id, candidate_type, published_at,
observed_at; chunks have chunk_id, chunk_no (their order), url, title, quote, published_at, and for
filters source_id and theme_section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import functions as fn
from newsloom.functions.folders import saved
from newsloom.operators import evidence
from newsloom.operators import rules as R
from newsloom.operators.fulltext import FullTextIndex
from newsloom.operators.selection import top_per_group

# Claim types by candidate type.
SUPPLEMENTAL_TYPES = ["deal", "general_tech", "guide", "manual_review", "meme_gallery", "off_topic_entertainment", "pc_hardware_or_event"]
KEPT_TYPES = ["rumor", "platform_price", "hardware_platform", "review_score", "news"]
# Language of observable events.
OBSERVABLE = "宣布|公布|发布|上线|发售|更新|关闭|裁员|announced|released|launched|updated|closed|reported|confirmed|stated"

_NO_EVIDENCE = "array<struct<rank:int,chunk_id:string,url:string,title:string,quote:string>>"


def candidate_query() -> Column:
    """Title, snippet and query of a candidate, those that are there."""
    return F.concat_ws(" ", *(F.when(F.coalesce(c, F.lit("")) != "", F.col(c)) for c in ("title", "snippet", "query")))


def chunk_text() -> Column:
    """What keyword retrieval looks at: title, quote and URL."""
    return F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("title", "quote", "url")))


def passes_filters(source_ids: list[str] | None = None, theme_sections: list[str] | None = None, start: Column | None = None, end: Column | None = None) -> Column:
    """Whether a chunk passes the metadata filters; a chunk without a time passes any window, one without a section no section filter."""
    ok = F.lit(True)
    if source_ids:
        ok = ok & F.coalesce(F.col("source_id").cast("string"), F.lit("")).isin(list(source_ids))
    if theme_sections is not None:
        ok = ok & F.coalesce(F.col("theme_section"), F.lit("")).isin([s for s in theme_sections if s])
    at = F.col("published_at")
    if start is not None:
        ok = ok & (at.isNull() | (at >= start))
    if end is not None:
        ok = ok & (at.isNull() | (at <= end))
    return ok


def keyword_packs(queries: DataFrame, query_id: str, query_text: Column, chunks: DataFrame, top_k: int = 5) -> DataFrame:
    """(query id, chunk_id, score, rank): the chunks that hold the most distinct query words; newest first among equals, then in their order."""
    newest = F.coalesce(F.unix_micros("published_at"), F.lit(-(2**62)).cast("long"))
    # queries of the same words find the same chunks, so each set of words is asked once
    worded = saved(queries.select(query_id, F.array_sort(F.array_distinct(fn.query_tokens(query_text))).alias("_w")).where(F.size("_w") > 0), "asked")
    sets = saved(worded.groupBy("_w").agg(F.min(query_id).alias("_set")), "word_sets")
    hits = evidence.word_hits(chunks.withColumn("_text", chunk_text()), "chunk_id", F.col("_text"), sets, "_set", F.col("_w"), top_k, tie=[(newest, True), (F.col("chunk_no"), False)])
    ranked = hits.join(chunks.select("chunk_id", "published_at", "chunk_no"), "chunk_id")
    best = top_per_group(ranked, "_set", [F.desc("hits"), F.col("published_at").desc_nulls_last(), F.col("chunk_no")], top_k)
    asking = worded.join(sets, "_w").select(query_id, "_set")
    return best.join(asking, "_set").select(query_id, "chunk_id", F.col("hits").alias("score"), "rank")


def context_packs(candidates: DataFrame, chunks: DataFrame, top_k: int = 5) -> DataFrame:
    """Adds evidence, evidence_scope and missing_fields to the candidates.

    Evidence are the first ``top_k`` chunks of the candidate's URL (scope candidate_url), else those
    that keyword retrieval finds for its title, snippet and query (retrieved_context), else none.
    """
    first = top_per_group(chunks.where("url is not null"), "url", [F.col("chunk_no")], top_k)
    item = lambda rank: F.struct(F.col(rank).cast("int").alias("rank"), F.col("chunk_id").cast("string").alias("chunk_id"), "url", F.col("c_title").alias("title"), "quote")
    named = first.select("url", "rank", "chunk_id", F.col("title").alias("c_title"), "quote")
    same = candidates.where("url is not null").select("candidate_id", "url").join(named, "url").groupBy("candidate_id").agg(F.array_sort(F.collect_list(item("rank"))).alias("same"))
    lone = candidates.join(same.select("candidate_id"), "candidate_id", "left_anti").select("candidate_id", candidate_query().alias("_query"))
    found = keyword_packs(lone, "candidate_id", F.col("_query"), chunks, top_k).join(chunks.select("chunk_id", "url", F.col("title").alias("c_title"), "quote"), "chunk_id")
    other = found.groupBy("candidate_id").agg(F.array_sort(F.collect_list(item("rank"))).alias("other"))
    both = candidates.join(same, "candidate_id", "left").join(other, "candidate_id", "left")
    both = both.withColumn("evidence_scope", F.when(F.col("same").isNotNull(), "candidate_url").when(F.col("other").isNotNull(), "retrieved_context").otherwise("none"))
    missing = fn.reasons(
        (F.col("evidence_scope") == "none", "evidence"),
        (F.col("evidence_scope") == "retrieved_context", "source_document"),
        (F.col("published_at").isNull() & F.col("observed_at").isNull(), "time"),
    )
    return both.withColumns({"evidence": F.coalesce("same", "other", F.array().cast(_NO_EVIDENCE)), "missing_fields": missing}).drop("same", "other")


def claim_type(candidate_type: Column) -> Column:
    return fn.first_match([(candidate_type == "discussion_search_lead", "search_lead"), (candidate_type.isin(SUPPLEMENTAL_TYPES), "supplemental_context"), (candidate_type.isin(KEPT_TYPES), candidate_type)], "fact_candidate")


def _clean_title(title: Column) -> Column:
    """White space collapsed, and the site's name cut off behind " _ " or " | "."""
    t = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "))
    return F.trim(F.substring_index(F.trim(F.substring_index(t, " _ ", 1)), " | ", 1))


def _weak_title(title: Column) -> Column:
    compact = F.regexp_replace(title, r"\s+", "")
    return (F.length(compact) < 8) | (compact.rlike("^[A-Za-z0-9]+$") & (F.length(compact) < 12))


def claim_text() -> Column:
    """The candidate's title; for a weak one the first longer evidence title that holds it; without one the evidence's title or quote."""
    title = F.trim(F.coalesce("title", F.lit("")))
    titles = F.transform("evidence", lambda e: _clean_title(e["title"]))
    better = F.filter(titles, lambda t: (t != "") & (F.length(t) > F.length(title)) & F.contains(F.lower(t), F.lower(title)))
    some = F.filter(F.transform("evidence", lambda e: F.coalesce(F.nullif(_clean_title(e["title"]), F.lit("")), F.substring(F.trim(F.coalesce(e["quote"], F.lit(""))), 1, 180))), lambda t: t != "")
    own = F.when(_weak_title(title), F.coalesce(F.try_element_at(better, F.lit(1)), title)).otherwise(title)
    return F.when(title != "", own).otherwise(F.coalesce(F.try_element_at(some, F.lit(1)), F.lit("Untitled claim")))


def claims(packs: DataFrame) -> DataFrame:
    """One claim per context pack: claim_id, text, story_id, source_urls, claim_type, extraction_status, evidence_chunk_ids, and the pack's fields."""
    own = F.col("evidence_scope") == "candidate_url"
    none = F.array().cast("array<string>")
    urls = F.concat(F.array("url"), F.when(own, F.transform("evidence", lambda e: e["url"])).otherwise(none))
    urls = F.array_distinct(F.filter(F.transform(urls, fn.clean), lambda u: u != ""))
    named = F.coalesce(*(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)) for c in ("url", "title", "source_id")), F.lit(""))
    story = fn.short_hash(named, "story_")
    if "story_cluster_id" in packs.columns:
        story = F.when(fn.clean(F.col("story_cluster_id")) != "", fn.clean(F.col("story_cluster_id"))).otherwise(story)
    return packs.select(
        F.col("candidate_id").alias("claim_id"),
        claim_text().alias("text"),
        story.alias("story_id"),
        urls.alias("source_urls"),
        claim_type(F.coalesce("candidate_type", F.lit(""))).alias("claim_type"),
        F.when(F.array_contains("missing_fields", "evidence"), "needs_evidence").otherwise("candidate_claim").alias("extraction_status"),
        F.when(own, F.transform("evidence", lambda e: e["chunk_id"])).otherwise(none).alias("evidence_chunk_ids"),
        "missing_fields",
        "evidence_scope",
    )


def verified_claims(claims_: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds n_evidence, support_score, check_status, confidence and verification_reason to the claims.

    A claim's evidence are the chunks it names by id or URL; support is the share of its words that
    stand in any of them. A pair of claim and chunk sends the claim's words it holds, not its text.
    """
    chunks = chunks.withColumn("chunk_id", F.col("chunk_id").cast("string"))
    links = evidence.evidence_for_claims(claims_, chunks)
    low = F.lower(F.coalesce("quote", F.lit("")))
    held = links.join(claims_.select("claim_id", fn.claim_tokens(F.col("text")).alias("words")), "claim_id").join(chunks.select("chunk_id", low.alias("low")), "chunk_id")
    held = held.select("claim_id", "chunk_id", F.filter("words", lambda t: F.contains(F.col("low"), t)).alias("found"))
    n = held.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_evidence"))
    hits = held.select("claim_id", F.explode("found").alias("word")).distinct().groupBy("claim_id").agg(F.count(F.lit(1)).alias("hits"))
    out = claims_.join(n, "claim_id", "left").join(hits, "claim_id", "left").na.fill(0, ["n_evidence", "hits"])
    size = F.size(fn.claim_tokens(F.col("text")))
    out = out.withColumn("_support", F.when((size == 0) | (F.col("n_evidence") == 0), F.lit(0.0)).otherwise(F.col("hits") / size))
    status = evidence.claim_status(F.col("claim_type"), F.col("n_evidence"), F.col("_support"))
    out = out.withColumns({"_s": status, "support_score": F.round("_support", 3)})
    return out.withColumns({"check_status": F.col("_s.check_status"), "confidence": F.col("_s.confidence"), "verification_reason": F.col("_s.reason")}).drop("_s", "_support", "hits")


def fact_and_inference(text: Column) -> Column:
    """struct(factual_part, inference_part, fact_confidence, inference_confidence, split_marker, is_separable): split at the first causal marker."""
    t = F.trim(F.coalesce(text, F.lit("")))
    marker = F.regexp_extract(t, f"({R.CAUSAL_ZH}|{R.CAUSAL_EN})", 1)
    at = F.instr(t, marker)
    fact, why = F.trim(F.substring(t, F.lit(1), at - 1)), F.trim(F.substring(t, at, F.length(t)))
    long, tail = F.length(fact) >= 10, F.length(why) >= 5
    sure = F.when(long & tail, 0.75).when(long, 0.8).when(tail, 0.5).otherwise(0.4)
    guess = F.when(long & tail, 0.7).when(long, 0.5).when(tail, 0.7).otherwise(0.4)
    sure = F.when(fn.matches(f"({OBSERVABLE})", fact), F.least(sure + 0.15, F.lit(0.95))).otherwise(sure)
    row = lambda a, b, c, d, m, s: F.struct(a.alias("factual_part"), b.alias("inference_part"), F.round(c, 2).alias("fact_confidence"), F.round(d, 2).alias("inference_confidence"), m.alias("split_marker"), F.lit(s).alias("is_separable"))
    none, zero = F.lit(""), F.lit(0.0)
    return F.when(t == "", row(none, none, zero, zero, none, False)).when(marker == "", row(t, none, F.lit(0.9), zero, none, False)).otherwise(row(fact, why, sure, guess, marker, True))


def retrieve_evidence(queries: DataFrame, query_id: str, query_text: Column, chunks: DataFrame, max_results: int = 5, where: Column | None = None, keyword_where: Column | None = None, index: FullTextIndex | None = None, **filters) -> DataFrame:
    """(query id, retriever, chunk_id, score, rank): from the full-text index if it is built, else BM25 with filters, for queries that finds nothing for by keywords.

    The index answers alone, by its relevance_score and with the ``filters`` of its search.

    BM25's statistics are of all chunks; ``where`` (see ``passes_filters``) holds for the chunks that
    may be returned. ``keyword_where`` holds for those of the keyword search, which filters by source only.
    """
    if index is not None and index.exists():
        best = index.search(queries, query_id, query_text, max_results, **filters)
        return best.select(query_id, F.lit("fts5").alias("retriever"), "chunk_id", F.col("relevance_score").alias("score"), "rank")
    docs = chunks.withColumn("_text", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("quote", F.lit(""))))
    found = evidence.bm25(docs, "chunk_id", F.col("_text"), queries, query_id, query_text, max_results, where=where).withColumn("retriever", F.lit("bm25"))
    rest = queries.join(found.select(query_id).distinct(), query_id, "left_anti")
    words = keyword_packs(rest, query_id, query_text, chunks if keyword_where is None else chunks.where(keyword_where), max_results)
    words = words.select(query_id, F.lit("keyword").alias("retriever"), "chunk_id", F.col("score").cast("double").alias("score"), "rank")
    return found.select(query_id, "retriever", "chunk_id", "score", "rank").unionByName(words)
