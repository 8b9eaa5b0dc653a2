"""Collection, contracts, heat observations, full-text retrieval and best matches as queries, each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom import functions as fn
from newsloom.functions.folders import saved, shared_folder
from newsloom.operators import contracts, events, evidence, heat, matching, memory, quality, requests
from newsloom.operators.fulltext import FullTextIndex
from newsloom.plans.news_sql import _canon, _norm, _words
from newsloom.sources import landed, listing

NOW = "2024-01-20T00:00:00+00:00"


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _now():
    return F.to_timestamp(F.lit("2024-01-20 00:00:00"))


# Full-text retrieval


def _evidence(spark, d):
    """Chunks of all documents: title (the first line), quote, a URL and source; their run is the language."""
    docs = _t(spark, d, "documents").withColumns({"run_id": F.coalesce("lang", F.lit("none")), "title": F.element_at(F.split("text", "\n"), 1)})
    cut = evidence.chunks(docs.select(F.struct("doc_id", "source", "run_id", "title").alias("doc"), "text"), "doc", F.col("text"))
    chunk_id, url = (F.col("doc.doc_id") * 100_000 + F.col("chunk_index")).alias("chunk_id"), F.concat(F.lit("doc:"), "doc.doc_id").alias("url")
    return cut.select("doc.run_id", chunk_id, "doc.title", "quote", F.col("doc.source").alias("source_id"), url)


def _index(spark, d):
    """The index of all chunks, added run by run: English first, then all other languages."""
    index = FullTextIndex(spark, shared_folder(spark, "fulltext"))
    chunks = _evidence(spark, d)
    index.add("en", chunks.where("run_id = 'en'").drop("run_id"))
    index.add("other", chunks.where("run_id <> 'en'").drop("run_id"))
    return index


def fulltext_search(spark, d):
    found = _index(spark, d).search(_t(spark, d, "benchmark"), "item_id", F.col("text"))
    return found.select("item_id", "run_id", "chunk_id", "relevance_score", "rank")


def fulltext_by_section(spark, d):
    """Full-text search among chunks whose document, as a candidate of the same run, is in the section of good ones, from two sources."""
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")
    run = F.when(F.col("lang") == "en", "en").otherwise("other")
    candidates = docs.select(run.alias("run_id"), F.concat(F.lit("doc:"), "doc_id").alias("url"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("theme_section"))
    found = _index(spark, d).search(_t(spark, d, "benchmark"), "item_id", F.col("text"), source_ids=["src1", "src2"], sections=["good"], candidates=candidates)
    return found.select("item_id", "run_id", "chunk_id", "relevance_score", "rank")


def _fts(x):
    marked = f"regexp_replace(coalesce({x}, ''), '([㐀-䶿一-鿿])', ' \\1 ', 'g')"
    return f"regexp_extract_all(lower(strip_accents({marked})), '[\\p{{L}}\\p{{N}}]+')"


_FTS = f"""c AS (SELECT doc_id, source, CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS run_id, string_split(text, chr(10))[1] AS title, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t FROM documents),
w AS (SELECT *, unnest(generate_series(0, CASE WHEN length(t) <= 700 THEN 0 ELSE CAST(ceil((length(t) - 700) / 580.0) AS INT) END)) AS i FROM c WHERE t <> ''),
ch AS (SELECT run_id, source, doc_id, doc_id * 100000 + i AS chunk_id, list_concat({_fts('title')}, {_fts("trim(substr(t, i * 580 + 1, 700))")}) AS toks FROM w),
tot AS (SELECT count(*) AS n, sum(len(toks)) / count(*) AS avgdl FROM ch),
tf AS (SELECT run_id, source, doc_id, chunk_id, token, len(any_value(toks)) AS dl, count(*) AS tf FROM (SELECT run_id, source, doc_id, chunk_id, toks, unnest(toks) AS token FROM ch) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
aw AS (SELECT item_id, unnest(list_distinct({_words('text', "'a','an','and','are','for','from','in','is','of','on','the','to','with'")})) AS word FROM benchmark),
asked AS (SELECT item_id, token, count(*) AS times FROM (SELECT item_id, unnest(CASE WHEN regexp_full_match(word, '[㐀-䶿一-鿿]+') THEN string_split(word, '') ELSE [word] END) AS token FROM aw) GROUP BY 1, 2),
s AS (SELECT item_id, run_id, source, doc_id, chunk_id, sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM asked JOIN df USING (token) JOIN tf USING (token), tot GROUP BY ALL)"""
_FTS_TOP = """SELECT item_id, run_id, chunk_id, round(-score, 4) AS relevance_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, run_id, chunk_id) AS rank FROM {}) WHERE rank <= 5"""
FULLTEXT = f"WITH {_FTS} {_FTS_TOP.format('s')}"
FULLTEXT_SECTION = f"WITH {_FTS}, f AS (SELECT s.* FROM s JOIN labels l ON s.doc_id = l.doc_id AND quality = 1 WHERE source IN ('src1', 'src2')) {_FTS_TOP.format('f')}"


# Listings and collection


def listing_links(spark, d):
    """Links of all pages, each URL once a page, by the table function in a lateral join."""
    found = listing.links_of(_t(spark, d, "pages"), "url", "html", _now())
    return found.where("found.kind = 'link'").select("page_id", F.col("found.position").alias("position"), F.col("found.url").alias("link"), F.col("found.title").alias("title"), F.col("found.listing_strategy").alias("strategy"))


def listing_diagnostics(spark, d):
    found = listing.links_of(_t(spark, d, "pages"), "url", "html", _now())
    return found.where("found.kind = 'page'").select("page_id", *(F.col(f"found.{c}").cast("long").alias(c) for c in listing.COUNTS), F.col("found.listing_strategy").alias("strategy"))


_LINK = '<li><a href="([^"]*)">([^<]*)</a></li>'
_ROOT = "regexp_extract(url, '^[^:]+://[^/?#]+')"
_LINKS = f"""x AS (SELECT page_id, url, html, unnest(generate_series(1, len(regexp_extract_all(html, '{_LINK}')))) AS i FROM pages),
a AS (SELECT page_id, url, i, replace(regexp_extract_all(html, '{_LINK}', 1)[i], '&amp;', '&') AS href, trim(replace(regexp_extract_all(html, '{_LINK}', 2)[i], '&amp;', '&')) AS title FROM x),
b AS (SELECT page_id, i, {_ROOT} || href AS link, title, row_number() OVER (PARTITION BY page_id, {_ROOT} || href ORDER BY i) AS k FROM a WHERE title <> '')"""
LISTING_LINKS = f"WITH {_LINKS} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS position, link, title, 'li_listing' AS strategy FROM b WHERE k = 1"
LISTING_DIAGNOSTICS = f"""WITH {_LINKS}, n AS (SELECT page_id, count(*) AS links FROM a GROUP BY 1), u AS (SELECT page_id, count(*) FILTER (k = 1) AS kept, count(*) FILTER (k > 1) AS twice FROM b GROUP BY 1)
SELECT p.page_id, octet_length(encode(html)) AS raw_html_bytes, coalesce(links, 0) AS link_count, coalesce(kept, 0) AS candidate_count, coalesce(kept, 0) AS missing_time_count, coalesce(twice, 0) AS duplicate_url_count, 0 AS title_repair_count,
  CASE WHEN coalesce(links, 0) = 0 THEN 1 ELSE 0 END AS parse_warning_count, 0 AS article_link_count, 0 AS article_link_candidate_count, 0 AS article_link_context_time_count, 'li_listing' AS strategy
FROM pages p LEFT JOIN n USING (page_id) LEFT JOIN u USING (page_id)"""

_GROUPS = "0123456789abcdef"


def collected_sources(spark, d):
    """Sixteen paged sources behind a JSONP endpoint, over landed responses that hold all pages: what each gave, by kind of row."""
    group = F.substring(F.md5(F.col("url").cast("binary")), 1, 1)
    numbered = _t(spark, d, "pages").select(group.alias("node"), F.row_number().over(W.partitionBy(group).orderBy("page_id")).alias("page"), "html")
    payload = F.format_string('{"type":"updatenodelabel","isCache":true,"cacheTime":60,"nodeId":"%s","isNodeId":"true","page":%d}', "node", "page")
    url = F.concat(F.lit("https://list.example/api?jsondata="), F.url_encode(payload))
    body = F.concat(F.lit("cb("), F.to_json(F.struct(F.col("html").alias("body"))), F.lit(");"))
    path = shared_folder(spark, "landed")
    landed.land(numbered.select(url.alias("url"), body.alias("text")), path)
    paged = lambda g: {"pagination_url": "https://list.example/api", "max_pages_per_entry": 1_000_000, "pagination_entries": [{"node_id": g, "theme_section": "pc"}]}
    catalog = [{"id": f"group_{g}", "collector": "jsonp_listing", "page_url": "https://list.example/", "tags": ["listed"], "collector_config": paged(g)} for g in _GROUPS]
    spark.dataSource.register(landed.LandedSource)
    rows = spark.read.format("landed").options(path=path, catalog=json.dumps(catalog), discovered_at=NOW, lookback_hours="48").load()
    # read once for both results, without the texts that neither needs
    rows = saved(rows.select("kind", "source_id", "entry_no", "page", "position", "url", "title", "theme_section", "entry_theme", "entry_label", "entry_url", "tags", "link_count", "duplicate_url_count", "error"), "collected")
    n = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    kinds = rows.groupBy("source_id").agg(*map(n, ("raw", "candidate", "diagnostics", "error")), total("link_count", "links"), total("duplicate_url_count", "duplicates"), F.max(F.when(F.col("kind") == "error", F.col("error"))).alias("last_error"))
    one = landed.merged(rows).groupBy("source_id").agg(F.count(F.lit(1)).alias("n_merged"), F.max("times_seen").alias("most_seen"))
    return kinds.join(one, "source_id", "left").na.fill(0, ["n_merged", "most_seen"])


COLLECTED = f"""WITH p AS (SELECT page_id, html, 'https://list.example/' AS url, substr(md5(url), 1, 1) AS g, row_number() OVER (PARTITION BY substr(md5(url), 1, 1) ORDER BY page_id) AS page FROM pages),
{_LINKS.replace('FROM pages', 'FROM p')},
n AS (SELECT g, page, (SELECT count(*) FROM a WHERE a.page_id = p.page_id) AS links, (SELECT count(*) FROM b WHERE b.page_id = p.page_id AND k = 1) AS kept, (SELECT count(*) FROM b WHERE b.page_id = p.page_id AND k > 1) AS twice, page_id FROM p),
stop AS (SELECT g, min(page) FILTER (kept = 0) AS last FROM n GROUP BY 1),
r AS (SELECT n.*, last FROM n JOIN stop USING (g) WHERE last IS NULL OR page <= last),
seen AS (SELECT r.g, link, count(*) AS times FROM r JOIN b USING (page_id) WHERE k = 1 GROUP BY 1, 2),
m AS (SELECT g, count(*) AS n_merged, max(times) AS most_seen FROM seen GROUP BY 1),
t AS (SELECT g, count(*) AS pages, sum(kept) AS kept, sum(links) AS links, sum(twice) AS twice, any_value(last) AS last FROM r GROUP BY 1)
SELECT 'group_' || e.g AS source_id, coalesce(pages, 0) + CASE WHEN last IS NULL THEN 1 ELSE 0 END AS n_raw, coalesce(kept, 0)::BIGINT AS n_candidate, coalesce(pages, 0) AS n_diagnostics, CASE WHEN last IS NULL THEN 1 ELSE 0 END AS n_error,
  coalesce(links, 0)::BIGINT AS links, coalesce(twice, 0)::BIGINT AS duplicates, CASE WHEN last IS NULL THEN 'not_landed' END AS last_error, coalesce(n_merged, 0) AS n_merged, coalesce(most_seen, 0) AS most_seen
FROM (SELECT unnest(string_split('{_GROUPS}', '')) AS g) e LEFT JOIN t USING (g) LEFT JOIN m USING (g)"""


# Contracts

_CONTRACTS = [("documents", True, ["title", "source_id", "content", "quality"], [["lang", "toxic"], ["published_at", "toxic"]]), ("events", False, ["k", "page"], []), ("pages", True, ["html"], []), ("labels", False, [], [])]


def _artifacts(spark, d):
    """Documents as lists of one record, the properties of events as objects, pages as JSON files that are none and as HTML files, labels without rules."""
    row = lambda key, name, run, body: (F.concat_ws(":", F.lit(key), *name[:1]).alias("file_id"), run.alias("run_id"), F.lit(key.split("-")[0]).alias("artifact_key"), F.lit(name[1]).alias("file_name"), F.lit(True).alias("present"), body.alias("body"))
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    fields = F.struct(F.element_at(F.split("text", "\n"), 1).alias("title"), F.col("source").alias("source_id"), F.col("text").alias("content"), "lang", "quality", "toxic")
    rows = docs.select(*row("documents", (F.col("doc_id"), "documents.json"), F.coalesce("lang", F.lit("none")), F.to_json(F.array(fields))))
    rows = rows.unionByName(_t(spark, d, "events").select(*row("events", (F.col("event_id"), "events.json"), F.col("event_type"), F.col("props"))))
    pages = _t(spark, d, "pages")
    rows = rows.unionByName(pages.select(*row("pages", (F.col("page_id"), "pages.json"), F.lit("web"), F.col("html")))).unionByName(pages.select(*row("pages-html", (F.col("page_id"), "pages.html"), F.lit("web"), F.col("html"))))
    labels = _t(spark, d, "labels")
    return rows.unionByName(labels.select(*row("labels", (F.col("doc_id"), "labels.json"), F.lit("labels"), F.to_json(F.struct("quality")))))


def schema_report(spark, d):
    """How many artifacts of each run have which errors and records."""
    report = contracts.schema_report(_artifacts(spark, d), contracts.contracts(spark, _CONTRACTS))
    by = ("run_id", "artifact_key", "file_name", "valid", "skip_reason", F.array_join("errors", ",").alias("errors"), "n_errors", "record_count")
    return report.select(*by).groupBy("run_id", "artifact_key", "file_name", "valid", "skip_reason", "errors", "n_errors", "record_count").agg(F.count(F.lit(1)).alias("n"))


_BLANK = "trim(coalesce({}, '')) = ''"
SCHEMA_REPORT = f"""WITH d AS (SELECT coalesce(lang, 'none') AS run_id, string_split(text, chr(10))[1] AS title, source, text, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
e AS (SELECT run_id, list_filter([
    CASE WHEN title IS NULL THEN 'missing_field' WHEN {_BLANK.format('title')} THEN 'empty_field' END, CASE WHEN source IS NULL THEN 'missing_field' WHEN {_BLANK.format('source')} THEN 'empty_field' END,
    CASE WHEN text IS NULL THEN 'missing_field' WHEN {_BLANK.format('text')} THEN 'empty_field' END, CASE WHEN quality IS NULL THEN 'missing_field' END,
    CASE WHEN {_BLANK.format('lang')} AND toxic IS NULL THEN 'missing_alternative_field' END, CASE WHEN toxic IS NULL THEN 'missing_alternative_field' END], lambda x: x IS NOT NULL) AS errs FROM d),
r AS (
  SELECT run_id, 'documents' AS artifact_key, 'documents.json' AS file_name, len(errs) = 0 AS valid, '' AS skip_reason, array_to_string(list_sort(list_distinct(errs)), ',') AS errors, len(errs) AS n_errors, 1 AS record_count FROM e
  UNION ALL SELECT event_type, 'events', 'events.json', false, '', CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'missing_field' ELSE 'missing_field' END, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 2 ELSE 1 END, 1 FROM events WHERE json_extract_string(props, '$.page') IS NULL
  UNION ALL SELECT 'web', 'pages', 'pages.json', false, '', 'json_parse_error', 1, NULL FROM pages
  UNION ALL SELECT 'web', 'pages', 'pages.html', true, 'unsupported_artifact_format', '', 0, NULL FROM pages
  UNION ALL SELECT 'labels', 'labels', 'labels.json', true, '', '', 0, 1 FROM labels)
SELECT run_id, artifact_key, file_name, valid, skip_reason, errors, n_errors::BIGINT AS n_errors, record_count::INT AS record_count, count(*) AS n FROM r GROUP BY ALL"""


# Heat observations

_PROVIDERS = [
    {"provider_id": "talk", "platform": "forum", "access_method": "api", "output_schema": {"result_type": {"source": "speaker"}, "url": {"source": "link"}, "snippet": {"source": "said"}, "engagement_signals": {"source": "counts"}, "evidence_texts": {"source": "quotes"}, "turn": {}}},
    {"provider_id": "site", "access_method": "Public_Search", "output_schema": {"platform": {"source": "host", "default": "web"}, "result_type": {"source": "form", "default": "page"}, "url": {"source": "href"}, "snippet": {"source": "caption"}, "top_results": {"source": "hits"}}},
]


def _observed(spark, d):
    """Turns of conversations and pages, each in the JSON of its own provider."""
    talk = _t(spark, d, "conversations").where("conv_id is not null")
    text = F.coalesce("text", F.lit(""))
    said = F.struct(F.col("role").alias("speaker"), F.concat_ws("/", F.lit("conv:"), "conv_id", "turn").alias("link"), F.substring_index(text, "\n", 1).alias("said"), F.struct(F.length(text).alias("letters")).alias("counts"), F.array(text).alias("quotes"), "turn", F.current_date().alias("unmapped"))
    rows = talk.select(F.concat_ws(":", F.lit("talk"), "conv_id", "turn").alias("obs_id"), F.lit("talk").alias("provider_id"), F.to_json(said).alias("body"))
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    shown = F.struct(F.nullif(fn.url_host(F.col("url")), F.lit("")).alias("host"), F.col("url").alias("href"), title.alias("caption"), F.array(F.struct(title.alias("title"), F.col("url").alias("snippet"))).alias("hits"))
    return rows.unionByName(_t(spark, d, "pages").select(F.concat_ws(":", F.lit("site"), "page_id").alias("obs_id"), F.lit("site").alias("provider_id"), F.to_json(shown).alias("body")))


def heat_observations(spark, d):
    """Two providers with field names of their own in one pass."""
    found = heat.normalized(_observed(spark, d), heat.mapping(spark, _PROVIDERS), heat.providers(spark, _PROVIDERS), _now())
    return found.select("obs_id", "platform", "result_type", "url", "snippet", "timestamp", "access_method", "heat_validity_hint", F.try_element_at("extra", F.lit("turn")).alias("turn"))


def _any(words, x):
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _hint(game, talk):
    return f"CASE WHEN {game} AND {talk} THEN 'game_discussion' WHEN {talk} THEN 'general_social_heat' ELSE 'unclear' END"


_SPACED = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
HEAT_OBSERVATIONS = f"""WITH t AS (SELECT 'talk:' || conv_id || ':' || turn AS obs_id, role, conv_id, turn, coalesce(text, '') AS text, {_SPACED.format("coalesce(text, '')")} AS low FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT 'site:' || page_id AS obs_id, url, {_TITLE} AS title, {_SPACED.format(_TITLE + " || ' ' || url")} AS low, regexp_extract(url, '^[^:]*://([^/]*)', 1) AS host FROM pages)
SELECT obs_id, 'forum' AS platform, coalesce(nullif(trim(role), ''), 'unknown') AS result_type, 'conv:/' || conv_id || '/' || turn AS url, trim(string_split(text, chr(10))[1]) AS snippet, '2024-01-20 00:00:00' AS timestamp, 'api_or_search_service' AS access_method,
  {_hint(_any(heat.GAME_WORDS, 'low'), '(length(text) > 0 OR ' + _any(heat.TALK_WORDS, 'low') + ')')} AS heat_validity_hint, CAST(turn AS VARCHAR) AS turn FROM t
UNION ALL SELECT obs_id, CASE WHEN host = '' THEN 'web' ELSE host END, 'page', url, trim(title), '2024-01-20 00:00:00', 'public_search', {_hint(_any(heat.GAME_WORDS, 'low'), _any(heat.TALK_WORDS, 'low'))}, NULL FROM p"""


def heat_summary(spark, d):
    """All counters of the heat report in one aggregation: orders as observations, their priority as platform."""
    o = _t(spark, d, "orders")
    mode = F.when(F.col("o_orderstatus") == "F", "public_search").when(F.col("o_orderstatus") == "O", "manual_import").otherwise("browser_sidecar")
    status = F.when(F.col("o_orderpriority").rlike("^[12]"), "ok").when(F.col("o_orderpriority").rlike("^3"), "manual_required").when(F.col("o_orderpriority").rlike("^4"), "login_required").otherwise("blocked")
    hint = F.when(F.col("o_totalprice") > 200000, "game_discussion").when(F.col("o_totalprice") > 100000, "general_social_heat").otherwise("unclear")
    return heat.heat_summary(o.select(F.col("o_orderpriority").alias("platform"), mode.alias("access_mode"), status.alias("status"), hint.alias("heat_validity_hint")))


HEAT_SUMMARY = """WITH o AS (SELECT o_orderpriority AS platform, CASE o_orderstatus WHEN 'F' THEN 'public_search' WHEN 'O' THEN 'manual_import' ELSE 'browser_sidecar' END AS access_mode,
  CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'ok' WHEN o_orderpriority[1] = '3' THEN 'manual_required' WHEN o_orderpriority[1] = '4' THEN 'login_required' ELSE 'blocked' END AS status,
  CASE WHEN o_totalprice > 200000 THEN 'game_discussion' WHEN o_totalprice > 100000 THEN 'general_social_heat' ELSE 'unclear' END AS hint FROM orders)
SELECT 'platform' AS dimension, platform AS value, count(*) AS n FROM o GROUP BY 2 UNION ALL SELECT 'access_mode', access_mode, count(*) FROM o GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM o GROUP BY 2
UNION ALL SELECT 'heat_validity_hint', hint, count(*) FROM o GROUP BY 2 UNION ALL SELECT 'total', 'total_observations', count(*) FROM o UNION ALL SELECT 'total', 'public_search_ok', count(*) FROM o WHERE access_mode = 'public_search' AND status = 'ok'
UNION ALL SELECT 'total', 'manual_required', count(*) FROM o WHERE status = 'manual_required' UNION ALL SELECT 'total', 'blocked_or_login_required', count(*) FROM o WHERE status IN ('blocked', 'login_required') UNION ALL SELECT 'total', 'game_discussion', count(*) FROM o WHERE hint = 'game_discussion'"""


# Best matches


def _web(spark, d):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return _t(spark, d, "pages").select(F.col("page_id").alias("id"), "url", title.alias("title"), F.array(F.regexp_extract("html", '<html lang="([^"]*)"', 1)).alias("entities"))


def historical_matches(spark, d):
    """For each page at http the best match among those at https: path words on one host, title words, the language as entity."""
    pages = _web(spark, d)
    found = matching.best_matches(pages.where("url like 'http:%'").withColumn("url", F.regexp_replace("url", "^http:", "https:")), pages.where("url like 'https:%'"))
    return found.select("candidate_id", "memory_id", F.round("score", 4).alias("score"), "band")


_SET = "list_distinct(list_filter(string_split({}, ' '), lambda t: t <> ''))"
_HOST, _PATH = "regexp_extract(u, '^[^:]*://([^/]*)', 1)", "regexp_extract(u, '^[^:]*://[^/]*(.*)$', 1)"
_JACC = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END"
HISTORICAL = f"""WITH r AS (SELECT page_id, url LIKE 'http:%' AS plain, {_canon("regexp_replace(url, '^http:', 'https:')")} AS u, {_SET.format(_norm(_TITLE))} AS w, list_distinct([regexp_extract(html, '<html lang="([^"]*)"', 1)]) AS e FROM pages),
s AS (SELECT *, {_HOST} AS h, list_distinct(regexp_extract_all(lower({_PATH}), '[a-z0-9]+|[一-鿿]+')) AS q FROM r),
c AS (SELECT * FROM s WHERE plain), m AS (SELECT * FROM s WHERE NOT plain),
x AS (SELECT c.page_id AS cid, m.page_id AS mid, CASE WHEN c.u = '' OR m.u = '' OR c.h <> m.h THEN 0.0 WHEN c.u = m.u THEN 1.0 WHEN len(c.q) = 0 OR len(m.q) = 0 THEN 0.3 ELSE {_JACC.format('c.q', 'm.q')} END AS su,
  {_JACC.format('c.w', 'm.w')} AS st, len(list_intersect(c.e, m.e)) / least(len(c.e), len(m.e)) AS se FROM c, m),
y AS (SELECT cid, mid, round(CASE WHEN su = 1.0 THEN greatest(0.5 * su + 0.35 * st + 0.15 * se, 0.95) ELSE 0.5 * su + 0.35 * st + 0.15 * se END, 4) AS score FROM x),
b AS (SELECT * FROM y WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY cid ORDER BY score DESC, mid) = 1)
SELECT c.page_id AS candidate_id, mid AS memory_id, score, CASE WHEN score >= 0.9 THEN 'duplicate' WHEN score >= 0.55 THEN 'likely_duplicate' WHEN score >= 0.3 THEN 'related' ELSE 'distinct' END AS band FROM c LEFT JOIN b ON c.page_id = cid"""


def _linked(spark, d):
    """Pages with the URLs that their listings lead to."""
    found = listing.links_of(_t(spark, d, "pages"), "url", "html", _now()).where("found.kind = 'link'")
    return _t(spark, d, "pages").select("page_id", "html").join(found.groupBy("page_id").agg(F.collect_list("found.url").alias("urls")), "page_id", "left").withColumn("urls", F.coalesce("urls", F.array().cast("array<string>")))


def story_packs(spark, d):
    """Pages in English as stories, all pages as packs: the first two packs that lead to a URL of the story, else the pack at its place."""
    pages = _linked(spark, d)
    return matching.matching_packs(pages.where("html like '%<html lang=\"en\"%'").select(F.col("page_id").alias("story_no"), "urls"), pages.select(F.col("page_id").alias("pack_no"), "urls"))


STORY_PACKS = f"""WITH {_LINKS}, l AS (SELECT DISTINCT page_id, link FROM b WHERE regexp_matches(link, '^https?://')), st AS (SELECT page_id FROM pages WHERE html LIKE '%<html lang="en"%'),
j AS (SELECT DISTINCT s.page_id AS story_no, o.page_id AS pack_no FROM l s JOIN st USING (page_id) JOIN l o ON s.link = o.link), f AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY story_no ORDER BY pack_no) <= 2)
SELECT story_no, pack_no, 'url' AS by FROM f UNION ALL SELECT page_id, page_id, 'position' FROM st WHERE page_id NOT IN (SELECT story_no FROM j)"""


def theme_replacements(spark, d):
    """For each document the eight longest pages of its language, one for each title; documents without a language take any."""
    lang = F.regexp_extract("html", '<html lang="([^"]*)"', 1)
    pool = _t(spark, d, "pages").select(F.col("page_id").alias("candidate_no"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("key"), F.when(F.col("url").contains("?"), "").otherwise(lang).alias("theme_section"), F.length("html").cast("double").alias("heat_score"))
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("story_id"), F.col("lang").alias("theme_section"))
    return matching.replacements(docs, pool)


REPLACEMENTS = f"""WITH p AS (SELECT page_id, {_TITLE} AS key, CASE WHEN contains(url, '?') THEN '' ELSE regexp_extract(html, '<html lang="([^"]*)"', 1) END AS theme, length(html) AS heat FROM pages),
t AS (SELECT DISTINCT coalesce(trim(lang), '') AS want FROM documents), f AS (SELECT want, p.* FROM t JOIN p ON want = '' OR theme = '' OR theme = want),
o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY want, CASE WHEN key = '' THEN 'n' || page_id ELSE 'k' || key END ORDER BY page_id) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY want ORDER BY heat DESC, page_id) AS rank FROM o)
SELECT doc_id AS story_id, rank, page_id AS candidate_no FROM documents JOIN r ON coalesce(trim(lang), '') = want WHERE rank <= 8"""


# Quality of a run, timelines of its story clusters


def _quality(spark, d):
    """Events as candidates, customers as stories of their nation, suppliers as posts, nations as sources by their region."""
    e, c, s = _t(spark, d, "events"), _t(spark, d, "customer"), _t(spark, d, "supplier")
    kind = lambda k: e.where(F.col("event_type") == k)
    status = F.element_at(F.array(*(F.lit(x) for x in ("healthy", "healthy", "needs_fill", "source_blocked", "source_broken"))), (F.col("n_regionkey") + 1).cast("int"))
    return quality.metrics({
        "candidates": kind("view").select(F.col("user_id").alias("source_id"), (F.col("value") > 5).alias("has_heat"), (F.col("value") > 12).alias("has_discussion")), "supplemental": kind("click"), "rejected": kind("error"), "documents": _t(spark, d, "documents"),
        "verifications": _t(spark, d, "labels"), "stories": c.select(F.array(F.concat(F.lit("https://www.n"), "c_nationkey", F.lit(".example/x"))).alias("source_urls"), (F.col("c_acctbal") < 0).alias("has_rumor")),
        "posts": s.select(F.lit(False).alias("has_rumor"), F.when(F.col("s_acctbal") < 0, "manual_fill_required").alias("asset_status")), "llm_requests": _t(spark, d, "part"), "llm_results": _t(spark, d, "nation"), "health": _t(spark, d, "nation").select(status.alias("status")),
    })


def content_quality_report(spark, d):
    return quality.report(_quality(spark, d)).withColumn("issues", F.array_join("issues", ","))


def content_quality_stages(spark, d):
    """Each stage's score and status with its criteria, in order of their names."""
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("criteria")), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    return quality.stage_scores(_quality(spark, d)).withColumn("criteria", shown)


_Q = """m AS (SELECT (SELECT count(*) FROM events WHERE event_type = 'view') AS cand, (SELECT count(*) FROM events WHERE event_type = 'click') + (SELECT count(*) FROM events WHERE event_type = 'error') AS lanes, (SELECT count(*) FROM documents) AS docs,
  (SELECT count(*) FROM labels) AS ver, (SELECT count(*) FROM customer) AS st, (SELECT count(*) FROM supplier) AS posts, (SELECT count(*) FROM part) AS req, (SELECT count(*) FROM nation) AS res,
  (SELECT round(count(*) FILTER (value > 12) / count(*), 4) FROM events WHERE event_type = 'view') AS disc, (SELECT round(max(n) / sum(n), 4) FROM (SELECT count(*) AS n FROM events WHERE event_type = 'view' GROUP BY user_id)) AS cshare,
  (SELECT round(max(n) / sum(n), 4) FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)) AS sshare, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS rumors, (SELECT count(*) FROM supplier WHERE s_acctbal < 0) AS manual,
  (SELECT count(*) FILTER (n_regionkey < 2) FROM nation) AS ok, (SELECT count(*) FILTER (n_regionkey = 2) FROM nation) AS fill, (SELECT count(*) FILTER (n_regionkey > 2) FROM nation) AS bad),
k AS (SELECT *, round(docs / cand, 4) AS cover, round(manual / posts, 4) AS mratio, ok + fill + bad AS src FROM m),
c(stage, criterion, raw, weight) AS (
  SELECT 'source_collection', 'healthy_source_ratio', ok / src * 100, 0.7 FROM k UNION ALL SELECT 'source_collection', 'blocked_source_penalty', (1 - bad / src) * 100, 0.2 FROM k UNION ALL SELECT 'source_collection', 'manual_fill_penalty', (1 - fill / src) * 100, 0.1 FROM k
  UNION ALL SELECT 'candidate_filtering', 'candidate_volume', least(100, cand * 10), 0.25 FROM k UNION ALL SELECT 'candidate_filtering', 'source_diversity', (1 - cshare) * 100, 0.35 FROM k UNION ALL SELECT 'candidate_filtering', 'lane_separation', CASE WHEN lanes > 0 THEN 100 ELSE 60 END, 0.2 FROM k
  UNION ALL SELECT 'candidate_filtering', 'discussion_signal_support', disc * 100, 0.2 FROM k UNION ALL SELECT 'evidence_fetch', 'document_coverage', cover * 100, 0.65 FROM k UNION ALL SELECT 'evidence_fetch', 'minimum_evidence_depth', least(100, docs * 12), 0.35 FROM k
  UNION ALL SELECT 'claim_verification', 'rule_verification_coverage', 100, 0.35 FROM k UNION ALL SELECT 'claim_verification', 'llm_or_manual_coverage', res / req * 100, 0.45 FROM k UNION ALL SELECT 'claim_verification', 'rumor_safety', CASE WHEN rumors > 0 AND res = 0 THEN 0 ELSE 100 END, 0.2 FROM k
  UNION ALL SELECT 'story_selection', 'story_volume', least(100, st * 25), 0.35 FROM k UNION ALL SELECT 'story_selection', 'story_source_diversity', (1 - sshare) * 100, 0.45 FROM k UNION ALL SELECT 'story_selection', 'briefing_focus', CASE WHEN st <= 8 THEN 80 ELSE 60 END, 0.2 FROM k
  UNION ALL SELECT 'platform_packaging', 'copy_coverage', least(1.0, posts / st) * 100, 0.45 FROM k UNION ALL SELECT 'platform_packaging', 'asset_readiness', (1 - mratio) * 100, 0.35 FROM k UNION ALL SELECT 'platform_packaging', 'reviewability', 85, 0.2 FROM k),
x AS (SELECT stage, criterion, least(greatest(round_even(raw::DOUBLE, 0), 0), 100)::INT AS score, weight::DOUBLE AS weight FROM c),
s AS (SELECT stage, CASE WHEN stage = 'evidence_fetch' AND (SELECT docs FROM k) >= 5 THEN greatest(60, v) ELSE v END AS score, criteria FROM (SELECT stage, least(greatest(round_even(sum(score * weight) / sum(weight), 0), 0), 100)::INT AS v, string_agg(criterion || '=' || score, ',' ORDER BY criterion) AS criteria FROM x GROUP BY 1))"""
QUALITY_STAGES = f"WITH {_Q} SELECT stage, score, CASE WHEN score >= 85 THEN 'pass' WHEN score >= 60 THEN 'needs_review' ELSE 'blocked' END AS status, criteria FROM s"
QUALITY_REPORT = f"""WITH {_Q}, o AS (SELECT max(score) FILTER (stage = 'source_collection') AS source_collection, max(score) FILTER (stage = 'candidate_filtering') AS candidate_filtering, max(score) FILTER (stage = 'evidence_fetch') AS evidence_fetch,
  max(score) FILTER (stage = 'claim_verification') AS claim_verification, max(score) FILTER (stage = 'story_selection') AS story_selection, max(score) FILTER (stage = 'platform_packaging') AS platform_packaging FROM s),
i AS (SELECT list_filter([CASE WHEN ok = 0 AND bad > 0 THEN 'source_collection_blocked' END, CASE WHEN cand >= 4 AND disc < 0.4 THEN 'low_discussion_signal_coverage' END, CASE WHEN st >= 3 AND sshare >= 0.67 THEN 'single_source_story_dominance' END,
  CASE WHEN docs < least(cand, 5) THEN 'limited_document_fetch' END, CASE WHEN manual = posts THEN 'manual_assets_required' END], lambda v: v IS NOT NULL) AS codes FROM k),
t AS (SELECT *, least(greatest(round_even(source_collection * 0.15::DOUBLE + candidate_filtering * 0.15::DOUBLE + evidence_fetch * 0.2::DOUBLE + claim_verification * 0.25::DOUBLE + story_selection * 0.15::DOUBLE + platform_packaging * 0.1::DOUBLE, 0), 0), 100)::INT AS overall_score FROM o, i)
SELECT CASE WHEN list_contains(codes, 'source_collection_blocked') THEN 'blocked' WHEN len(codes) > 0 THEN 'needs_review' ELSE 'pass' END AS gate_status, overall_score,
  CASE WHEN list_contains(codes, 'source_collection_blocked') THEN 'blocked' WHEN len(codes) = 0 AND overall_score >= 85 THEN 'ready_for_layout' ELSE 'ready_for_content_review' END AS readiness, array_to_string(codes, ',') AS issues,
  source_collection, candidate_filtering, evidence_fetch, claim_verification, story_selection, platform_packaging FROM t"""


def _clusters(spark, d):
    """Documents as story clusters about their source, labels as their claims."""
    docs = _t(spark, d, "documents")
    identity = F.concat(F.lit("story_"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    clusters = docs.select(identity.alias("story_cluster_id"), F.element_at(F.split("text", "\n"), 1).alias("canonical_title"), F.array(F.upper("source")).alias("entity_signatures"), F.array("source").alias("source_urls"), F.lit(1).alias("candidate_count"))
    kind = F.when(F.col("toxic") == 1, "rumor").when(F.col("quality") == 1, "news").otherwise("review_score")
    claims = _t(spark, d, "labels").join(docs, "doc_id").select(identity.alias("story_id"), F.col("doc_id").alias("claim_no"), F.col("doc_id").cast("string").alias("claim_id"), kind.alias("candidate_type"), F.timestamp_seconds(1_700_000_000 + F.col("n_chars")).alias("published_at"))
    return clusters, claims


def cluster_timelines(spark, d):
    t = events.cluster_timelines(*_clusters(spark, d))[0]
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return t.select("event_id", "event_key", "timeline_label", shown("started_at"), shown("last_updated_at"), "entry_count", "has_official_confirmation", "has_community_reaction", "has_correction")


def timeline_entries(spark, d):
    return events.cluster_timelines(*_clusters(spark, d))[1].select("event_id", "story_cluster_id", "chronological_index", "event_label", "event_type", "candidate_type", "claim_count")


_TYPES = " ".join(f"WHEN regexp_matches(txt, '{p}', 'i') THEN '{name}'" for name, p in events.EVENT_TYPES.items())
_CORRECTED = _any(events.CORRECTIONS, "lower(coalesce(title, ''))")
_TL = f"""l AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'rumor' WHEN quality = 1 THEN 'news' ELSE 'review_score' END AS kind, n_chars FROM labels JOIN documents USING (doc_id)),
r AS (SELECT 'story_' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS sid, string_split(text, chr(10))[1] AS title, source, coalesce(kind, 'news') AS kind, CASE WHEN kind IS NULL THEN 0 ELSE 1 END AS claims, TIMESTAMP '2023-11-14 22:13:20' + to_seconds(l.n_chars) AS tm FROM documents d LEFT JOIN l USING (doc_id)),
t AS (SELECT *, concat_ws(' ', title, kind) AS txt FROM r),
y AS (SELECT *, CASE {_TYPES} WHEN kind = 'rumor' THEN 'leak_or_rumor' WHEN kind = 'review_score' THEN 'review_or_score' WHEN kind = 'platform_price' THEN 'price_or_market' ELSE 'general_news' END AS et, {_CORRECTED} AS fixed FROM t),
k AS (SELECT *, 'ev:' || CASE WHEN source IS NULL THEN 'no_entity' ELSE substr(sha1(lower(source)), 1, 16) END || ':' || et AS event_key FROM y),
o AS (SELECT *, substr(sha1(event_key), 1, 12) AS event_id, CAST(row_number() OVER (PARTITION BY event_key ORDER BY coalesce(tm, TIMESTAMP '2000-01-01'), sid) - 1 AS INT) AS i FROM k)"""
TIMELINE_ENTRIES = f"""WITH {_TL} SELECT event_id, sid AS story_cluster_id, i AS chronological_index, CASE WHEN fixed THEN 'correction' WHEN i = 0 THEN 'initial_report' WHEN et = 'confirmed_report' AND kind = 'news' THEN 'official_confirmation' WHEN et = 'community_reaction' THEN 'reaction' ELSE 'new_detail' END AS event_label,
  et AS event_type, kind AS candidate_type, claims AS claim_count FROM o"""
TIMELINES = f"""WITH {_TL} SELECT event_id, event_key, CASE WHEN arg_min(source, i) IS NULL THEN '未识别游戏' ELSE upper(arg_min(source, i)) END || CASE WHEN any_value(et) = 'confirmed_report' THEN ' — 官方动态时间线' ELSE ' — 事件时间线' END AS timeline_label,
  strftime((array_agg(tm ORDER BY i))[1], '%Y-%m-%d %H:%M:%S') AS started_at, strftime((array_agg(tm ORDER BY i))[-1], '%Y-%m-%d %H:%M:%S') AS last_updated_at, count(*) AS entry_count, any_value(et) = 'confirmed_report' AS has_official_confirmation, any_value(et) = 'community_reaction' AS has_community_reaction, bool_or(fixed) AS has_correction FROM o GROUP BY event_id, event_key"""


def localization_requests(spark, d):
    """Documents in English as stories, their chunks as evidence; pages as the pool, those of two domains as if in Chinese; labelled good ones are selected."""
    docs = _t(spark, d, "documents")
    cut = evidence.chunks(docs, "doc_id", F.col("text")).where("chunk_index < 4").join(docs.select("doc_id", "source"), "doc_id")
    quotes = cut.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.col("source").alias("source_id"), F.lit("").alias("title"), "quote"))).alias("e"))
    quotes = quotes.select("doc_id", F.transform("e", lambda x: F.struct(x["source_id"].alias("source_id"), x["title"].alias("title"), x["quote"].alias("quote"))).alias("evidence"))
    stories = docs.join(quotes, "doc_id", "left").select(F.col("doc_id").alias("ordinal"), F.col("doc_id").alias("id"), F.element_at(F.split("text", "\n"), 1).alias("title"), F.col("lang").alias("source_language"), F.lit("").alias("source_preference"), F.lit("en").alias("theme_section"), "evidence")
    lang = F.regexp_extract("html", '<html lang="([^"]*)"', 1)
    source = F.when(F.col("url").contains("spam"), "weibo").otherwise(fn.url_host(F.col("url")))
    pool = _t(spark, d, "pages").select(F.col("page_id").alias("candidate_no"), F.col("url").alias("key"), F.when(F.col("url").contains("?"), "").otherwise(lang).alias("theme_section"), F.length("html").cast("double").alias("heat_score"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), "url", source.alias("source_id"))
    chosen = _t(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    found = matching.localization_requests(stories, pool, chosen)
    return found.select("request_id", "title", "selected_final_story", F.size("evidence_quotes").alias("n_quotes"), F.array_join(F.transform("candidate_replacements", lambda x: x["url"]), " ").alias("urls"))


LOCALIZATION = """WITH p AS (SELECT page_id, url, CASE WHEN contains(url, '?') THEN '' ELSE regexp_extract(html, '<html lang="([^"]*)"', 1) END AS theme, length(html) AS heat FROM pages WHERE contains(url, 'spam')),
t AS (SELECT * FROM p WHERE theme IN ('', 'en') QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1), r AS (SELECT string_agg(url, ' ' ORDER BY heat DESC, page_id) AS urls FROM (SELECT * FROM t ORDER BY heat DESC, page_id LIMIT 8)),
c AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, length(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) AS n FROM documents WHERE lang = 'en')
SELECT 'story_localization:' || c.doc_id AS request_id, coalesce(title, '') AS title, coalesce(quality = 1, false) AS selected_final_story, CASE WHEN coalesce(n, 0) = 0 THEN 0 WHEN n <= 700 THEN 1 WHEN n <= 1280 THEN 2 ELSE 3 END AS n_quotes, coalesce(urls, '') AS urls FROM c LEFT JOIN labels USING (doc_id), r"""


# Search expansion

_THEME = {"en": "pc", "de": "sony", "fr": "nintendo", "es": "microsoft"}


def search_expansion_requests(spark, d):
    """Forty searches: themes by the languages of documents, pages as candidates, whose titles name no event, with one that does."""
    docs, pages = _t(spark, d, "documents"), _t(spark, d, "pages")
    theme = lambda c: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in _THEME.items() for x in kv)), c), F.lit("supplemental"))
    counts = docs.groupBy(theme(F.col("lang")).alias("theme")).agg(F.count(F.lit(1)).alias("n"))
    title = F.concat_ws(" ", F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.when(F.col("url").contains("spam"), "gamescom demo revealed"))
    cands = pages.select("page_id", title.alias("title"), F.lit("").alias("snippet"), F.lit("").alias("query"), "url", theme(F.regexp_extract("html", '<html lang="([^"]*)"', 1)).alias("theme_section"))
    found = requests.expansion_requests("Zelda", counts, cands, "page_id", limit=40)
    return found.select("request_id", "request_no", "method", "theme_section", "query", "usage_policy", F.array_join(F.transform("search_targets", lambda t: t["url"]), " ").alias("urls"))


def _query(x):
    t = f"trim(regexp_replace(regexp_replace(regexp_replace({x}, 'https?://\\S+', ' ', 'g'), '[\\[\\]{{}}()|<>]', ' ', 'g'), '\\s+', ' ', 'g'))"
    cut = f"substr({t}, 1, 96)"
    return f"CASE WHEN length({t}) <= 96 THEN {t} WHEN trim(regexp_replace({cut}, ' [^ ]*$', '')) <> '' THEN trim(regexp_replace({cut}, ' [^ ]*$', '')) ELSE trim({cut}) END"


def _values(rows):
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


_LANG = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _THEME.items()) + " ELSE 'supplemental' END"
_TEMPLATES = [(2, "event_burst", "event_burst_search_expansion", i, t, x) for i, (t, x) in enumerate(requests.BURST_TEMPLATES)] + [(4, "new_content_watch", "new_content_watch_search_expansion", i, t, x) for i, (t, x) in enumerate(requests.WATCH_TEMPLATES)]
EXPANSION = f"""WITH n AS (SELECT {_LANG.format('lang')} AS theme, count(*) AS n FROM documents GROUP BY 1),
c AS (SELECT page_id, url, concat_ws(' ', {_TITLE}, CASE WHEN contains(url, 'spam') THEN 'gamescom demo revealed' END) AS title, {_LANG.format("regexp_extract(html, '<html lang=" + chr(34) + "([^" + chr(34) + "]*)" + chr(34) + "', 1)")} AS theme FROM pages),
seen AS (SELECT bool_or(contains(lower(title), 'gamescom')) AND bool_or(contains(lower(title), 'demo')) AS active FROM c),
s(theme, theme_no, seed_no, seed) AS (VALUES {_values([(t, i, j, q) for i, (t, qs) in enumerate(requests.THEME_SEEDS.items()) for j, q in enumerate(qs)])}),
t(pos, method, policy, i, theme, template) AS (VALUES {_values(_TEMPLATES)}),
r AS (SELECT 1 AS pos, 'theme_gap' AS method, 'low_frequency_search_expansion' AS policy, row_number() OVER (ORDER BY seed_no, coalesce(n, 0) >= 20, coalesce(n, 0), theme_no) AS at_, s.theme, seed || ' Zelda' AS query FROM s LEFT JOIN n USING (theme)
  UNION ALL SELECT pos, method, policy, i, theme, {_query("replace(template, '{}', 'gamescom')".replace('{}', '{' + '}'))} FROM t, seen WHERE active
  UNION ALL SELECT 3, 'candidate_followup', 'candidate_followup_search_expansion', k, theme, {_query("tt || ' 玩家讨论 热议'")} FROM (SELECT *, {_query('title')} AS tt, row_number() OVER (ORDER BY page_id) AS k FROM c WHERE trim(url) <> '' AND {_query('title')} <> '') WHERE k <= 40),
u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY lower(trim(query)) ORDER BY pos, at_) = 1),
v AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY at_) AS turn FROM u), w AS (SELECT *, row_number() OVER (ORDER BY turn, pos) AS request_no FROM v QUALIFY request_no <= 40)
SELECT 'search-expansion-' || method || '-' || theme || '-' || request_no AS request_id, request_no, method, theme AS theme_section, query, policy AS usage_policy,
  'https://search.bilibili.com/all?keyword=' || replace(url_encode(query), '%20', '+') || ' https://s.weibo.com/weibo?q=' || replace(url_encode(query), '%20', '+') AS urls FROM w"""


# Memory


def memory_store_update(spark, d):
    """The memory after two runs, the documents in English and then all of them, keyed by title."""
    docs = _t(spark, d, "documents")
    none = F.lit(None).cast("timestamp")
    cands = docs.select("doc_id", "lang", F.element_at(F.split("text", "\n"), 1).alias("title"), F.lit("").alias("url"), F.col("source").alias("source_id"), none.alias("published_at"), F.timestamp_seconds(F.col("n_chars")).alias("observed_at"))
    empty = spark.createDataFrame([], memory.RECORD)
    first = memory.updated_records(empty, cands.where("lang = 'en'"), "doc_id", _now()).drop("state")
    both = memory.updated_records(first, cands, "doc_id", _now() + F.expr("INTERVAL 1 DAY"))
    return both.select(
        "memory_key", F.date_format("first_seen_at", "yyyy-MM-dd").alias("first_seen"), F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen"), "seen_count", F.size("titles").alias("n_titles"), F.array_join("source_ids", ",").alias("sources"),
        F.size("published_at_values").alias("n_times"), "source_id", "state",
    )


MEMORY_UPDATE = f"""WITH c AS (SELECT doc_id, lang = 'en' AS en, trim(string_split(text, chr(10))[1]) AS title, array_to_string(regexp_extract_all(lower(string_split(text, chr(10))[1]), '[a-z0-9]+|[一-鿿]+'), ' ') AS n, source, n_chars FROM documents),
k AS (SELECT *, 'title:' || substr(sha1(n), 1, 16) AS memory_key FROM c WHERE n <> ''),
r AS (SELECT memory_key, coalesce(bool_or(en), false) AS old, count(*) + count(*) FILTER (en) AS seen_count, count(DISTINCT nullif(title, '')) AS n_titles, count(DISTINCT n_chars) AS n_times, arg_max(source, doc_id) FILTER (source IS NOT NULL) AS source_id FROM k GROUP BY 1),
f AS (SELECT memory_key, source, min(doc_id) FILTER (en) AS a, min(doc_id) AS b FROM k WHERE coalesce(source, '') <> '' GROUP BY 1, 2),
s AS (SELECT memory_key, string_agg(source, ',' ORDER BY a IS NULL, coalesce(a, b)) AS sources FROM f GROUP BY 1)
SELECT memory_key, CASE WHEN old THEN '2024-01-20' ELSE '2024-01-21' END AS first_seen, '2024-01-21' AS last_seen, seen_count, n_titles, coalesce(sources, '') AS sources, n_times, coalesce(source_id, '') AS source_id, CASE WHEN old THEN 'updated' ELSE 'new' END AS state FROM r LEFT JOIN s USING (memory_key)"""


ORACLE_SQL = {
    "fulltext_search": FULLTEXT, "fulltext_by_section": FULLTEXT_SECTION, "listing_links": LISTING_LINKS, "listing_diagnostics": LISTING_DIAGNOSTICS, "collected_sources": COLLECTED, "schema_report": SCHEMA_REPORT, "heat_observations": HEAT_OBSERVATIONS,
    "heat_summary": HEAT_SUMMARY, "historical_matches": HISTORICAL, "story_packs": STORY_PACKS, "theme_replacements": REPLACEMENTS,
    "content_quality_report": QUALITY_REPORT, "content_quality_stages": QUALITY_STAGES, "cluster_timelines": TIMELINES, "timeline_entries": TIMELINE_ENTRIES, "search_expansion_requests": EXPANSION, "memory_store_update": MEMORY_UPDATE, "localization_requests": LOCALIZATION,
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
