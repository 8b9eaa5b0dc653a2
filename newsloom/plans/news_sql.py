"""The news queries in DuckDB's SQL."""

from __future__ import annotations

NOW = "TIMESTAMP '2024-01-20 00:00:00'"
_STOP = "'a','an','and','are','for','from','in','is','of','on','the','to','with'"
_CLAIM_STOP = "'a','an','and','after','in','is','of','online','the','to'"


def _words(x: str, stop: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+|[一-鿿]{{2,}}'), lambda t: length(t) > 1 AND t NOT IN ({stop}))"


def _canon(x: str) -> str:
    host, path = rf"regexp_extract(trim({x}), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 2)", rf"regexp_replace(regexp_extract(trim({x}), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 3), '/+$', '')"
    scheme = rf"regexp_extract(trim({x}), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)"
    return f"CASE WHEN {host} = '' THEN '' ELSE lower({scheme}) || '://' || lower({host}) || CASE WHEN {path} = '' THEN '/' ELSE {path} END END"


def _norm(x: str, least: int = 10) -> str:
    t = f"array_to_string(regexp_extract_all(lower({x}), '[a-z0-9]+|[一-鿿]+'), ' ')"
    return f"CASE WHEN length(replace({t}, ' ', '')) < {least} THEN '' ELSE {t} END"


_TITLE = "string_split(text, chr(10))[1]"
_HTML_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_POOL = """pool AS (SELECT o_orderkey, o_custkey, n_regionkey AS section, o_totalprice, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
_ORDER = "priority, o_totalprice DESC, o_orderkey"
_MEMORY = f"""memory AS (SELECT 'url:https://example.com/' || user_id AS memory_key, min(ts) AS first_seen FROM events WHERE ts < TIMESTAMP '2024-01-11' GROUP BY 1),
cand AS (SELECT e.*, 'url:https://example.com/' || e.user_id AS k, first_seen, m.memory_key,
  CASE WHEN m.memory_key IS NULL THEN 'new_story' WHEN first_seen IS NULL THEN 'known_story_unknown_first_seen' WHEN date_diff('microsecond', first_seen, {NOW}) <= 240 * 3600000000 THEN 'known_recent_story'
    WHEN event_type = 'signup' THEN 'follow_up_update' ELSE 'late_repost' END AS memory_status
  FROM events e LEFT JOIN memory m ON 'url:https://example.com/' || e.user_id = m.memory_key)"""

RECENCY = f"""SELECT event_type, CASE WHEN ts IS NULL THEN 'missing_time' WHEN ts < {NOW} - INTERVAL 48 HOUR OR ts > {NOW} THEN 'outside_time_window' ELSE 'accepted' END AS outcome, count(*) AS n FROM events GROUP BY 1, 2"""

# Titles name one platform pattern, reddit; "trending" is one strong phrase.
HEAT = f"""WITH {_MEMORY},
x AS (SELECT c.*, s_suppkey, s_suppkey % 101 AS priority, s_suppkey % 3 AS kind,
  greatest(value * 100, 0) * 0.004 + greatest(value, 0) * 0.075 AS raw FROM cand c LEFT JOIN supplier ON user_id = s_suppkey),
y AS (SELECT *, CASE WHEN raw > 0 THEN least(45.0, 8 + ln(1 + raw) * 7) ELSE 0 END + 26.0 + 6.0 + CASE WHEN event_type = 'purchase' THEN 16.0 ELSE 0 END AS disc FROM x),
z AS (SELECT *, CASE WHEN ts IS NULL THEN 'missing_time' WHEN ts < {NOW} - INTERVAL 240 HOUR OR ts > {NOW} THEN 'outside_time_window' WHEN memory_status = 'late_repost' THEN 'late_repost_without_current_update'
    WHEN s_suppkey IS NOT NULL AND ('https://example.com/' || user_id) LIKE '%/13' THEN 'irrelevant_topic' END AS reject_reason FROM y)
SELECT event_id AS ordinal, reject_reason, memory_status, CASE WHEN reject_reason IS NOT NULL THEN -1.0 ELSE
  round(least(least(greatest(coalesce(priority, 50), 0), 100) * 0.12 + greatest(0, 1 - greatest(date_diff('microsecond', ts, {NOW}) / 3.6e9, 0) / 240) * 15.0
   + CASE WHEN kind = 0 THEN 8.0 WHEN kind = 1 THEN 4.0 WHEN kind = 2 THEN 2.0 ELSE 0 END
   + CASE WHEN event_type = 'error' THEN 7.0 WHEN event_type = 'purchase' THEN 6.0 ELSE 0 END + round(least(disc, 100.0), 2) * 0.45, 100.0), 2) END AS heat_score FROM z"""

MEMORY = f"WITH {_MEMORY} SELECT memory_status, count(*) AS n, count(DISTINCT user_id) AS urls FROM cand GROUP BY 1"
CANONICAL = f"SELECT {_canon('url')} AS canonical_url, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1"
TITLE = f"SELECT page_id, trim(regexp_replace({_HTML_TITLE}, '[ \\t\\n\\r]+', ' ', 'g')) AS title FROM pages"
TITLE_CLUSTERS = f"SELECT title_key, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, {_norm(_TITLE)} AS title_key FROM documents) WHERE title_key <> '' GROUP BY 1"
CASCADE = f"""WITH p AS (SELECT page_id, {_canon('url')} AS u, {_norm(_HTML_TITLE)} AS t, {_HTML_TITLE} AS title FROM pages), q AS (SELECT *, count(*) OVER (PARTITION BY u) AS c FROM p),
k AS (SELECT page_id, CASE WHEN c > 1 AND u <> '' THEN 'url:' || u WHEN t <> '' THEN 'title:news:' || t WHEN u <> '' THEN 'url:' || u ELSE 'fallback:news:' || substr(sha1(regexp_replace(trim(lower(title)), '\\s+', ' ', 'g')), 1, 12) END AS cluster_key,
  CASE WHEN c > 1 AND u <> '' THEN 'canonical_url' WHEN t <> '' THEN 'normalized_title' WHEN u <> '' THEN 'canonical_url' ELSE 'fallback_hash' END AS merge_reason FROM q)
SELECT cluster_key, min(merge_reason) AS merge_reason, count(*) AS candidate_count, min(page_id) AS first_ordinal, 'story_' || substr(sha1(cluster_key), 1, 12) AS story_cluster_id FROM k GROUP BY 1"""
CHUNKS = """WITH c AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t FROM documents),
w AS (SELECT doc_id, t, unnest(generate_series(0, CASE WHEN length(t) <= 700 THEN 0 ELSE CAST(ceil((length(t) - 700) / 580.0) AS INT) END)) AS i FROM c WHERE t <> '')
SELECT doc_id, count(*) AS n_chunks, sum(length(trim(substr(t, i * 580 + 1, 700))))::BIGINT AS n_chars FROM w GROUP BY 1"""
BM25 = f"""WITH d AS (SELECT doc_id, {_words('text', _STOP)} AS w FROM documents), stats AS (SELECT count(*) AS n, greatest(avg(len(w)), 1.0) AS avgdl FROM d),
p AS (SELECT doc_id, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS token FROM d) GROUP BY 1, 2),
f AS (SELECT token, count(*) AS df FROM p GROUP BY 1), q AS (SELECT item_id, unnest(list_distinct({_words('text', _STOP)})) AS token FROM benchmark),
s AS (SELECT item_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN p USING (token) JOIN f USING (token), stats GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5"""
_PAIRS = "items AS (SELECT item_id, text AS claim FROM benchmark), docs AS (SELECT doc_id, text AS doc_text FROM documents), pairs AS (SELECT * FROM items CROSS JOIN docs)"
KEYWORD = f"""WITH {_PAIRS}, s AS (SELECT item_id, doc_id, len(list_filter(list_distinct({_words('claim', _STOP)}), lambda t: contains(lower(doc_text), t))) AS score FROM pairs),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 5"""
SUPPORT = f"""WITH {_PAIRS}, c AS (SELECT item_id, doc_id, list_distinct({_words('claim', _CLAIM_STOP)}) AS ws, doc_text FROM pairs),
s AS (SELECT item_id, doc_id, CASE WHEN len(ws) = 0 OR doc_text = '' THEN 0.0 ELSE len(list_filter(ws, lambda t: contains(lower(doc_text), t))) / len(ws) END AS support, item_id % 3 AS k FROM c)
SELECT item_id, doc_id, round(support, 6) AS support,
 CASE WHEN k = 1 THEN 'rumor' WHEN support >= 0.45 OR (k = 0 AND support >= 0.25) THEN 'likely' ELSE 'reject' END AS check_status,
 round(CASE WHEN k = 1 THEN 0.35 + least(support, 1.0) * 0.25 WHEN support >= 0.45 THEN 0.45 + least(support, 1.0) * 0.35 WHEN k = 0 AND support >= 0.25 THEN 0.38 + least(support, 1.0) * 0.28 ELSE 0.1 END, 2) AS confidence FROM s"""
BURSTS = """WITH a AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
b AS (SELECT x.user_id, x.n, x.ts, max(y.n) + 1 AS e FROM a x JOIN a y ON x.user_id = y.user_id AND y.ts BETWEEN x.ts AND x.ts + INTERVAL 72 HOUR GROUP BY 1, 2, 3),
c AS (SELECT *, e - n >= 3 AS starts, coalesce(max(CASE WHEN e - n >= 3 THEN e END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM b),
d AS (SELECT *, sum(CASE WHEN starts AND n >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY n) AS burst FROM c)
SELECT user_id, burst::BIGINT AS burst, count(*) AS story_count, round(date_diff('microsecond', min(ts), max(ts)) / 3.6e9, 1) AS duration_hours FROM d WHERE starts OR n < reach GROUP BY user_id, burst"""
TIMELINE = """WITH a AS (SELECT event_id, user_id, event_type, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n,
 coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, i AS chronological_index, n AS entry_count, CASE WHEN event_type = 'error' THEN 'correction' WHEN i = 0 THEN 'initial_report' WHEN event_type = 'purchase' THEN 'official_confirmation' WHEN seen > 0 THEN 'reaction' ELSE 'new_detail' END AS entry_label FROM a"""
YEARS = """WITH y AS (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INT) AS y FROM orders), g AS (SELECT *, lag(y) OVER (PARTITION BY o_custkey ORDER BY y) AS b FROM y)
SELECT o_custkey, 'resumed_after_gap' AS pattern, b AS from_year, y AS to_year FROM g WHERE y - b >= 2
UNION ALL SELECT o_custkey, 'first_since_year', max(y), 2004 FROM y GROUP BY 1 HAVING 2004 - max(y) >= 2"""
# Pairs of equal sets are listed against the set's first document, as the query does.
JACCARD = f"""WITH t AS (SELECT doc_id, source, list_sort(list_distinct(regexp_extract_all(lower({_TITLE}), '[a-z0-9]+|[一-鿿]+'))) AS s FROM documents), u AS (SELECT * FROM t WHERE len(s) > 0),
f AS (SELECT source, s, min(doc_id) AS first_doc FROM u GROUP BY 1, 2)
SELECT u.source, first_doc AS id_a, doc_id AS id_b, 1.0::DOUBLE AS similarity FROM u JOIN f ON u.source = f.source AND u.s = f.s WHERE doc_id <> first_doc
UNION ALL SELECT a.source, least(a.doc_id, b.doc_id), greatest(a.doc_id, b.doc_id), round(len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s)), 6)
FROM u a JOIN u b ON a.source = b.source AND a.s < b.s WHERE len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s)) >= 0.65"""
URLS = f"""WITH p AS (SELECT {_canon('url')} AS u, min(page_id) AS page_id FROM pages GROUP BY 1),
h AS (SELECT *, regexp_extract(u, '^[^:]*://([^/]*)', 1) AS host, list_distinct(regexp_extract_all(lower(regexp_extract(u, '^[^:]*://[^/]*(.*)$', 1)), '[a-z0-9]+|[一-鿿]+')) AS w FROM p WHERE u <> ''),
s AS (SELECT a.page_id AS page_id_a, b.page_id AS page_id_b, len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)) AS similarity FROM h a JOIN h b ON a.host = b.host AND a.page_id < b.page_id WHERE len(a.w) > 0 AND len(b.w) > 0)
SELECT page_id_a, page_id_b, round(similarity, 6) AS similarity FROM s WHERE round(similarity, 6) >= 0.3"""
TOPK = f"WITH {_POOL} SELECT section, o_orderkey, row_number() OVER (PARTITION BY section ORDER BY {_ORDER}) AS rank FROM pool QUALIFY rank <= 20"
FINAL = f"""WITH {_POOL}, a AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY {_ORDER}) AS pr FROM pool),
s AS (SELECT section, o_orderkey, round(o_totalprice / 1000 + CASE WHEN priority = 1 THEN 12.0 WHEN priority = 2 THEN 8.0 ELSE 0 END, 6) AS score FROM a WHERE pr <= 20)
SELECT section, o_orderkey, score, row_number() OVER (PARTITION BY section ORDER BY score DESC, o_orderkey) AS rank FROM s QUALIFY rank <= 10"""
BACKFILL = f"""WITH {_POOL}, final AS (SELECT * FROM pool WHERE priority = 1 AND o_totalprice > 300000 QUALIFY row_number() OVER (PARTITION BY section ORDER BY {_ORDER}) <= 10),
short AS (SELECT r_regionkey AS section FROM region LEFT JOIN (SELECT section, count(*) AS n FROM final GROUP BY 1) ON section = r_regionkey WHERE coalesce(n, 0) < 200),
free AS (SELECT * FROM pool WHERE o_orderkey NOT IN (SELECT o_orderkey FROM final) AND section IN (SELECT section FROM short)),
b AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY {_ORDER}) AS fill_rank FROM free QUALIFY fill_rank <= 8)
SELECT section, o_orderkey, fill_rank FROM b ORDER BY fill_rank, section, {_ORDER} LIMIT 20"""
DOMINANCE = """WITH s AS (SELECT l_suppkey AS s_suppkey, count(*) AS c, count(*) FILTER (l_linestatus = 'F') AS d, count(*) FILTER (l_discount > 0.09) AS h, count(*) FILTER (l_quantity > 49) AS e, count(*) FILTER (l_returnflag = 'R') AS z
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
w AS (SELECT *, round(c / sum(c) OVER (), 4) AS share, max(d) OVER () AS most, row_number() OVER (ORDER BY c DESC, s_suppkey) = 1 AS top FROM s)
SELECT s_suppkey, c AS candidate_count, share AS candidate_share, round(d / c, 4) AS document_coverage, round(z / c, 4) AS noise_ratio, top AS dominant,
 array_to_string(list_filter([CASE WHEN top AND share >= 0.5 THEN 'volume_advantage' END, CASE WHEN d > 0 AND d = most THEN 'fetch_advantage' END, CASE WHEN h > 0 THEN 'language_advantage' END,
  CASE WHEN e > 0 THEN 'real_engagement_advantage' END, CASE WHEN e <= 0 AND h > 0 THEN 'false_heat_advantage' END, CASE WHEN z > 0 THEN 'noise_advantage' END], lambda x: x IS NOT NULL), ',') AS reasons FROM w"""
PIVOT = "SELECT n_name, " + ", ".join(f"count(*) FILTER (l_returnflag = '{f}' AND l_linestatus = '{s}') AS {f.lower()}_{s.lower()}" for f in "ANR" for s in "FO") + ", count(*) AS total FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name"
HEALTH = """WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS accepted, count(*) FILTER (event_type = 'view') AS rejected, count(*) FILTER (event_type = 'error' AND value < 2) AS blocked, count(*) FILTER (event_type = 'error' AND value >= 15) AS errors FROM events GROUP BY 1)
SELECT user_id, accepted, rejected, errors, CASE WHEN accepted >= 3 THEN 'healthy' WHEN blocked > 0 THEN 'source_blocked' WHEN errors > 0 THEN 'source_broken' WHEN accepted > 0 OR rejected > 0 THEN 'needs_fill' ELSE 'source_broken' END AS status FROM c"""
FUNNEL = f"""WITH {_POOL}, l AS (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS closed FROM lineitem GROUP BY 1),
c AS (SELECT section, count(*) AS src, count(*) FILTER (priority <= 4) AS p, count(*) FILTER (priority <= 4 AND l_orderkey IS NOT NULL) AS x, count(*) FILTER (priority <= 4 AND closed = 1) AS v, count(*) FILTER (priority <= 4 AND closed = 1 AND returned = 0) AS s FROM pool LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1)
SELECT section, p AS pool_count, x AS context_pack_count, v AS claim_verification_count, s AS story_candidate_count, least(s, 10) AS final_selected_count,
 CASE WHEN p > x THEN 'document_fetch_failure' WHEN x > v THEN 'claim_extraction_or_verification' WHEN v > s THEN 'story_publishability_filter' WHEN s > least(s, 10) THEN 'final_ranking_limit' WHEN src > p THEN 'candidate_pool_classification' ELSE 'no_drop_detected' END AS primary_bottleneck FROM c"""
DISCUSSION = """WITH c AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, sum(length(text)) AS chars FROM conversations GROUP BY 1),
s AS (SELECT conv_id, turns > 5 AS hot, asked > 3 AS tagged, least(45.0, 8 + ln(1 + turns * 0.075 + chars * 0.00022) * 7) + CASE WHEN turns > 5 THEN 30.0 + 30.0 ELSE 26.0 END + CASE WHEN asked > 3 THEN 16.0 ELSE 0 END AS raw FROM c)
SELECT conv_id, round(least(raw, 100.0), 2) AS score, CASE WHEN least(raw, 100.0) >= 70 THEN 'trending' WHEN raw >= 35 THEN 'discussed' WHEN raw >= 10 THEN 'weak' ELSE 'none' END AS level,
 CASE WHEN hot THEN 'reddit,steam' ELSE '' END AS platforms, raw >= 35 AS has_evidence FROM s"""
SCORECARD = """WITH s AS (SELECT (SELECT avg(CASE WHEN event_type <> 'error' THEN 100.0 ELSE 0 END) FROM events) AS collection, (SELECT avg(CASE WHEN value > 5 THEN 100.0 ELSE 0 END) FROM events) AS filtering,
 (SELECT avg(CASE WHEN length(text) >= 200 THEN 100.0 ELSE 0 END) FROM documents) AS evidence, (SELECT avg(CASE WHEN quality = 1 THEN 100.0 ELSE 0 END) FROM labels) AS verification,
 (SELECT avg(CASE WHEN toxic = 0 THEN 100.0 ELSE 0 END) FROM labels) AS selection, (SELECT avg(CASE WHEN contains(html, '<title>') THEN 100.0 ELSE 0 END) FROM pages) AS packaging),
t AS (SELECT *, CAST(round_even(collection * 0.15 + filtering * 0.15 + evidence * 0.20 + verification * 0.25 + selection * 0.15 + packaging * 0.10, 0) AS INT) AS overall FROM s)
SELECT round(collection, 4) AS collection, round(filtering, 4) AS filtering, round(evidence, 4) AS evidence, round(verification, 4) AS verification, round(selection, 4) AS selection, round(packaging, 4) AS packaging, overall,
 CASE WHEN overall >= 85 THEN 'pass' WHEN overall >= 60 THEN 'needs_review' ELSE 'fail' END AS readiness FROM t"""
FLAGS = f"SELECT 'short_title' AS flag, page_id AS item_id FROM pages WHERE length(trim({_HTML_TITLE})) < 40 UNION ALL SELECT 'empty_document_content', doc_id FROM documents WHERE length(trim(text)) < 40"
CONTRACT = """WITH j AS (SELECT text, source, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
e AS (SELECT 'missing:text' AS error FROM j WHERE coalesce(trim(text), '') = '' UNION ALL SELECT 'missing:source' FROM j WHERE coalesce(trim(source), '') = ''
 UNION ALL SELECT 'missing:quality' FROM j WHERE quality IS NULL UNION ALL SELECT 'missing_any:toxic|lang' FROM j WHERE toxic IS NULL AND coalesce(trim(lang), '') = '')
SELECT error, count(*) AS n FROM e GROUP BY 1"""
SAMPLE = """WITH c AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS c, count(*) OVER () AS n FROM documents),
q AS (SELECT *, least(c, greatest(1, CAST(floor(c * 100 / n) AS BIGINT))) AS q FROM c), picks AS (SELECT DISTINCT lang, CAST(floor(j * c / q) AS BIGINT) AS i FROM (SELECT DISTINCT lang, c, q, unnest(generate_series(0, q - 1)) AS j FROM q))
SELECT doc_id, lang FROM q JOIN picks USING (lang, i)"""
ROUND_ROBIN = f"""WITH d AS (SELECT doc_id, lang, {_TITLE} AS query, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS pos FROM documents),
o AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query ORDER BY pos, doc_id) = 1), t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM o)
SELECT row_number() OVER (ORDER BY turn, pos) AS request_no, doc_id, lang FROM t QUALIFY request_no <= 40"""
UPSERT = f"""WITH p AS (SELECT page_id, 'news_' || substr(sha1({_canon('url')}), 1, 12) AS item_id, length(html) AS n FROM pages),
o AS (SELECT item_id, min(page_id) AS seen, arg_max(n, page_id) AS n FROM p WHERE page_id % 2 = 0 GROUP BY 1), m AS (SELECT item_id, min(page_id) AS seen, arg_max(n, page_id) AS n FROM p WHERE page_id % 2 = 1 GROUP BY 1)
SELECT item_id, coalesce(o.seen, m.seen) AS first_seen, coalesce(m.n, o.n) AS n_chars FROM o FULL JOIN m USING (item_id)"""
PROPS = "SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS INT))::BIGINT AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INT) >= 50 GROUP BY 1"
STORIES = """WITH c AS (SELECT *, l_linestatus = 'O' AS pref FROM lineitem WHERE l_returnflag IN ('N', 'A'))
SELECT l_orderkey AS story_id, 'claim ' || arg_min(l_linenumber, CASE WHEN pref THEN 0 ELSE 100 END + l_linenumber) AS title, count(*) AS claim_count, count(DISTINCT l_suppkey) AS source_count,
 round(least(100.0, max(l_quantity) * 0.55 + max(l_tax * 100) * 0.25 + max(l_discount * 5) * 16.0 + max(CASE WHEN l_returnflag = 'N' THEN 12.0 ELSE 2.0 END) + count(DISTINCT l_suppkey) * 2.0), 2) AS story_score FROM c GROUP BY 1"""

ORACLE_SQL = {
    "recency_filter_rejects": RECENCY, "heat_score_rank": HEAT, "memory_freshness": MEMORY, "canonical_url_dups": CANONICAL, "html_title_extract": TITLE, "normalized_title_clusters": TITLE_CLUSTERS, "story_cluster_cascade": CASCADE,
    "evidence_chunks": CHUNKS, "bm25_search": BM25, "keyword_retrieval": KEYWORD, "claim_support_status": SUPPORT, "burst_detection": BURSTS, "event_timeline": TIMELINE, "year_gap_patterns": YEARS, "title_jaccard_pairs": JACCARD,
    "url_similarity_pairs": URLS, "section_topk_pool": TOPK, "section_final_selection": FINAL, "underfilled_backfill": BACKFILL, "source_dominance": DOMINANCE, "source_theme_pivot": PIVOT, "source_health": HEALTH,
    "stage_funnel_bottleneck": FUNNEL, "discussion_profile": DISCUSSION, "quality_scorecard": SCORECARD, "quality_flags": FLAGS, "schema_validation_errors": CONTRACT, "stratified_eval_sample": SAMPLE, "round_robin_requests": ROUND_ROBIN,
    "news_item_upsert": UPSERT, "json_props_filter": PROPS, "ranked_stories": STORIES,
}
