"""Full-text index, listings, landed sources, late sightings, contracts, heat observations and best matches."""

from __future__ import annotations

import json
import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from newsloom.operators import contracts, heat, matching, packs
from newsloom.operators.fulltext import FullTextIndex, packs_json
from newsloom.plans import intake
from newsloom.sources import landed, listing
from newsloom.streaming import late

NOW = datetime(2024, 1, 20, 12, tzinfo=timezone.utc)
CHUNK = "chunk_id string, title string, quote string, source_id string, url string, published_at timestamp, raw_json string"


def _chunk(i, title, quote, source="a", at=None, raw=None):
    return (i, title, quote, source, f"https://x/{i}", at, raw)


FIRST = [
    _chunk("1", "Zelda news", "a café in the zelda world zelda", raw='{"credibility_hint": "official"}'),
    _chunk("2", None, "原神 更新 zelda", "b", datetime(2024, 1, 1), '{"metadata": {"candidate_type": "news"}}'),
    _chunk("3", "", "nothing here", raw="broken"),
    _chunk(None, "zelda", "zelda"),
]
SECOND = [_chunk("4", "zelda", None, "b"), _chunk("5", "神", "原 原 world")]
ASKED = [(1, "zelda world"), (2, "原神"), (3, "the of"), (4, "absent"), (5, None), (6, "cafe")]


def _found(index, spark, **k):
    q = spark.createDataFrame(ASKED, "q int, text string")
    return sorted(map(tuple, index.search(q, "q", F.col("text"), **k).collect()))


def test_index_grows_by_runs(spark, tmp_path):
    """Two runs added one after the other, one of them twice, give what an index built anew gives."""
    grown, anew = FullTextIndex(spark, str(tmp_path / "grown"), 4), FullTextIndex(spark, str(tmp_path / "anew"), 4)
    df = lambda rows: spark.createDataFrame(rows, CHUNK)
    assert not grown.exists()
    grown.add("r1", df([_chunk("9", "zelda", "gone zelda world"), *FIRST]))
    before = _found(grown, spark)
    grown.add("r2", df(SECOND))
    grown.add("r1", df(FIRST))
    anew.add("r2", df(SECOND))
    anew.add("r1", df(FIRST))
    assert grown.exists() and before != _found(grown, spark) == _found(anew, spark)
    got = _found(grown, spark)
    assert [c for _, c in sorted((rank, c) for q, _, c, _, rank in got if q == 2)] == ["5", "2"] and {q for q, *_ in got} == {1, 2, 6}
    assert [r[2] for r in got if r[0] == 6] == ["1"] and all(r[3] <= 0 for r in got)
    assert {r[2] for r in _found(grown, spark, source_ids=["b"])} == {"2", "4"}
    assert {r[2] for r in _found(grown, spark, start=F.lit(datetime(2023, 1, 1)))} == {"2"}
    assert {r[1] for r in _found(grown, spark, runs=["r2"])} == {"r2"}
    cands = spark.createDataFrame([("r1", "https://x/1", "pc"), ("r1", "https://x/1", "pc"), ("r2", "https://x/2", "pc"), ("r1", "https://x/2", None)], "run_id string, url string, theme_section string")
    assert {r[2] for r in _found(grown, spark, sections=["pc"], candidates=cands)} == {"1"}


def test_index_shuffles_texts_and_tokens_once(spark, tmp_path):
    """Chunks carry what they need of their document without a join, and tokens are dealt once, where they are written; totals count chunks without words."""
    index = FullTextIndex(spark, str(tmp_path / "i"), 4)
    held = spark.createDataFrame([("1", 3, ["a", "b", "a"]), ("2", 0, [])], "chunk_id string, dl long, w array<string>")
    counted = index._counted(held)
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted((r.chunk_id, r.token, r.tf, r.dl) for r in counted.collect()) == [("1", "a", 2, 3), ("1", "b", 1, 3)]
    assert "Join" not in intake._evidence(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    index.add("none", spark.createDataFrame([_chunk("8", "!", "")], CHUNK))
    assert [(r.n_chunks, r.n_tokens) for r in index.table("totals").collect()] == [(1, 0)] and _found(index, spark) == []
    index.add("r1", spark.createDataFrame(FIRST, CHUNK))
    whole = index.table("postings").agg(F.sum("tf")).first()[0]
    assert index.table("totals").agg(F.sum("n_tokens")).first()[0] == whole and index.table("totals").where("run_id = 'none'").first().n_tokens == 0


def test_search_makes_no_row_for_each_pair(spark, tmp_path):
    """Results in blocks of any size are the best by a plain loop, and pairs of query and chunk are not dealt."""
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    WORDS = [a + b for a in ("za", "be", "ku", "mo") for b in ("lda", "nti", "rro")]
    held = {f"{i:03}": (text(2), text(rng.randrange(1, 12))) for i in range(120)}
    index = FullTextIndex(spark, str(tmp_path / "i"), 4)
    index.add("r1", spark.createDataFrame([_chunk(i, *x) for i, x in held.items()], CHUNK))
    asked = [(q, text(4)) for q in range(30)]
    docs = {i: " ".join(x).split() for i, x in held.items()}
    mean, want = sum(map(len, docs.values())) / len(docs), []
    for q, t in asked:
        scores = []
        for i, d in docs.items():
            s = 0.0
            for w in set(t.split()):
                n, tf = sum(w in x for x in docs.values()), d.count(w)
                s += max(math.log((len(docs) - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
            if s > 0:
                scores.append((-round(s, 9), i))
        want += [(q, i, rank) for rank, (_, i) in enumerate(sorted(scores)[:5], 1)]
    queries = spark.createDataFrame(asked, "q long, text string")
    for block in (256, 7):
        found = index.search(queries, "q", F.col("text"), block=block)
        assert sorted((r.q, r.chunk_id, r.rank) for r in found.collect()) == sorted(want)
        dealt = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x]
        assert dealt and not any("_q#" in x and "chunk_id#" in x.split("hashpartitioning")[1] for x in dealt)


def test_packs_ask_each_set_of_words_once(spark, monkeypatch):
    """Queries of the same words are sent to the chunks as one, in blocks of any size, and each has the chunks of a plain loop."""
    rng, words = random.Random(4), ["zelda", "mario", "sonic", "metroid", "kirby"]
    chunks = [(i, i % 7, None, " ".join(rng.sample(words, rng.randrange(4))), None, NOW + timedelta(hours=i % 5)) for i in range(40)]
    asked = [(q, " ".join(rng.sample(words, 2))) for q in range(60)]
    want = []
    for q, t in asked:
        hits = sorted((-sum(w in c[3] for w in t.split()), -(c[0] % 5), c[1], c[0]) for c in chunks if any(w in c[3] for w in t.split()))
        want += [(q, -h, (-at, no)) for h, at, no, _ in hits[:5]]
    word_hits, sent = packs.evidence.word_hits, []
    for block in (1024, 3):
        monkeypatch.setattr(packs.evidence, "word_hits", lambda *a, block=block, **k: (sent.append(a[3].count()), word_hits(*a, block=block, **k))[1])
        df = spark.createDataFrame(chunks, "chunk_id long, chunk_no long, title string, quote string, url string, published_at timestamp")
        got = packs.keyword_packs(spark.createDataFrame(asked, "q long, text string"), "q", F.col("text"), df).collect()
        assert sorted((r.q, r.score, (r.chunk_id % 5, r.chunk_id % 7)) for r in got) == sorted(want)
    assert sent == [len({frozenset(t.split()) for _, t in asked})] * 2


def test_evidence_takes_the_index_first(spark, tmp_path):
    index = FullTextIndex(spark, str(tmp_path / "i"), 4)
    chunks = spark.createDataFrame(FIRST[:3], CHUNK).withColumn("chunk_no", F.col("chunk_id").cast("int"))
    q = spark.createDataFrame(ASKED, "q int, text string")
    without = packs.retrieve_evidence(q, "q", F.col("text"), chunks, index=index)
    assert {r.retriever for r in without.collect()} <= {"bm25", "keyword"}
    index.add("r1", chunks)
    found = packs.retrieve_evidence(q, "q", F.col("text"), chunks, index=index)
    assert {(r.q, r.retriever) for r in found.collect()} == {(1, "fts5"), (2, "fts5"), (6, "fts5")}
    full = index.packs(index.search(q, "q", F.col("text")))
    said = {r.q: json.loads(r.json) for r in packs_json(q, "q", F.col("text"), full, "fts5", F.lit("now")).collect()}
    assert len(said) == 6 and said[3]["packs"] == [] and said[5]["query"] == ""
    assert {p["chunk_id"]: p["credibility_hint"] for p in said[1]["packs"]} == {"1": "official", "2": "news"}


PAGE = """<ul data-nodeid="7"><li>2h <a href="/a" title="Short">Short title that goes on</a> <a href="/a">again</a></li>
<li>2024-01-19 08:00 <a href="b?x=1">A &amp; B</a><ul><li><a href="//other/c" title="Inner">x</a></li></ul></li><li><a href="">none</a><a href="/d"></a></li></ul><a href="/articles/9">not in a list</a>"""
ARTICLES = """<div><a href="/articles/1">3h Big news 12</a><span>x</span><a href="/about">About</a><a href="/articles/1">again</a>
<a href="/articles/2" title=" "><img alt="Picture  title"></a> <p>昨天 10:30</p></div>"""


def test_listing_table_function(spark):
    pages = spark.createDataFrame([(1, "https://h/p/", PAGE), (2, "https://h/", ARTICLES), (3, "https://h/", None), (4, None, "<li>x</li>")], "n int, url string, html string")
    rows = listing.links_of(pages, "url", "html", F.lit(NOW.replace(tzinfo=None)).cast("timestamp"))
    assert rows.columns == ["n", "url", "found"]
    links = {n: [r.found for r in rows.collect() if r.n == n and r.found.kind == "link"] for n in (1, 2, 3, 4)}
    assert [(x.url, x.title, x.title_repaired, x.section_nodeid) for x in links[1]] == [("https://h/a", "Short title that goes on", True, "7"), ("https://h/p/b?x=1", "A & B", False, "7"), ("https://other/c", "Inner", False, "7")]
    assert [x.published_at for x in links[1]] == [datetime(2024, 1, 20, 10), datetime(2024, 1, 19), datetime(2024, 1, 19)]
    assert [(x.url, x.title, x.time_source, x.published_at) for x in links[2]] == [("https://h/articles/1", "Big news", "link_label", datetime(2024, 1, 20, 9)), ("https://h/articles/2", "Picture title", "nearby_article_context", datetime(2024, 1, 19, 2, 30))]
    page = {r.n: r.found for r in rows.where("found.kind = 'page'").collect()}
    assert (page[1].link_count, page[1].duplicate_url_count, page[1].title_repair_count, page[1].article_link_count) == (5, 1, 1, 0)
    assert (page[2].article_link_count, page[2].article_link_candidate_count, page[2].article_link_context_time_count, page[2].listing_strategy) == (3, 2, 1, "article_link_fallback")
    assert (page[3].raw_html_bytes, page[3].parse_warning_count, page[4].parse_warning_count) == (0, 1, 0)
    assert [tuple(r) for r in listing.section_counts(rows, "n").collect()] == [(1, "7", 3)]


def _item(age, href, title):
    return f'<li>{age} <a href="{href}">{title}</a></li>'


def test_landed_sources(spark, tmp_path):
    """All four families: paging, its stops, errors, duplicates, times from detail pages, what sources lack."""
    more = '<a href="/list?endIndex={}">Load More</a>'
    jsonp = lambda n, page: landed.jsonp_url({"pagination_url": "https://j/api?x=1"}, {"node_id": n}, page)
    assert jsonp("5", 2) == "https://j/api?x=1&jsondata=%7B%22type%22%3A%22updatenodelabel%22%2C%22isCache%22%3Atrue%2C%22cacheTime%22%3A60%2C%22nodeId%22%3A%225%22%2C%22isNodeId%22%3A%22true%22%2C%22page%22%3A2%7D"
    body = lambda html: f"cb({json.dumps({'body': html, 'totalPages': 9})});"
    rows = [
        ("https://f/rss", "<rss><item><title>One</title><link>https://f/1</link><pubDate>Fri, 19 Jan 2024 10:00:00 GMT</pubDate><category>c</category></item><item><title>No link</title></item></rss>", None),
        ("https://f/bad", "<rss>", None), ("https://f/down", None, "timeout"),
        ("https://l/", _item("", "/1", "first") + _item("", "/2", "second") + _item("", "/3", "third"), None), ("https://l/1", '<meta name="date" content="2024-01-18T00:00:00Z"><p>x</p>', None), ("https://l/2", "<p>x</p>", None),
        ("https://i/list", _item("1h", "/a", "new a") + more.format(2), None), ("https://i/list?endIndex=2", _item("1h", "/a", "new a") + _item("9d", "/b", "old b") + more.format(3), None), ("https://i/list?endIndex=3", _item("9d", "/c", "old c") + more.format(4), None),
        ("https://i/list?endIndex=4", _item("1h", "/never", "never read"), None),
        (jsonp("5", 1), body(_item("1h", "/x", "page one")), None), (jsonp("5", 2), body(""), None), (jsonp("6", 1), body(_item("1h", "/x", "page one")), None),
    ]
    path = str(tmp_path / "landed")
    responses = spark.createDataFrame(rows, "url string, text string, error string")
    landed.land(responses, path, parts=4)
    catalog = [
        {"id": "feed", "collector": "rss", "tags": ["t"], "feed_urls": ["https://f/rss", "https://f/bad", "https://f/down", "https://f/rss"]},
        {"id": "list", "collector": "listing", "page_url": "https://l/"},
        {"id": "next", "collector": "incremental_listing", "page_entries": [{"url": "https://i/list", "theme_section": "pc"}], "collector_config": {"max_pages_per_entry": 9}},
        {"id": "nodes", "collector": "jsonp_listing", "page_url": "https://j/", "collector_config": {"pagination_url": "https://j/api?x=1", "pagination_entries": [{"node_id": "5", "theme_section": "a"}, {"nodeId": "6", "theme_section": "b"}, {}]}},
        {"id": "odd", "collector": "telepathy"}, {"id": "", "collector": "jsonp_listing", "collector_config": {"next_url_patterns": ["("]}},
    ]
    spark.dataSource.register(landed.LandedSource)
    read = lambda sources: spark.read.format("landed").options(path=path, parts="4", catalog=json.dumps(sources), discovered_at=NOW.isoformat(), lookback_hours="48", query="q").load()
    df = read(catalog).cache()
    kind = lambda k, *cols: sorted(tuple(r[c] for c in cols) for r in df.where(F.col("kind") == k).collect())
    assert kind("candidate", "source_id", "page", "title") == [("feed", 1, "One"), ("list", 1, "first"), ("list", 1, "second"), ("list", 1, "third"), ("next", 1, "new a"), ("next", 2, "old b"), ("nodes", 1, "page one"), ("nodes", 1, "page one")]
    assert [(s, e.split(":")[0]) for s, e in kind("error", "source_id", "error")] == [("feed", "parse_error"), ("feed", "timeout"), ("nodes", "not_landed")]
    stops = {(r.source_id, r.node_id, r.page): (r.stop_reason, r.stale) for r in df.where("kind = 'diagnostics'").collect()}
    assert stops == {("list", None, 1): (None, False), ("next", None, 1): (None, False), ("next", None, 2): ("stale_page_limit", True), ("nodes", "5", 1): (None, False), ("nodes", "5", 2): ("empty_body", None), ("nodes", "6", 1): (None, False)}
    assert kind("contract", "source_id", "error") == [("", "invalid_pattern:next_url_patterns"), ("", "missing_entries"), ("", "missing_id"), ("", "missing_pagination_url"), ("odd", "unsupported_collector")]
    one = {(r.source_id, r.title): r for r in landed.merged(df).collect()}
    assert one["nodes", "page one"].times_seen == 2 and one["nodes", "page one"].entry_themes == ["a", "b"] and one["nodes", "page one"].theme_section is None and one["nodes", "page one"].tags == ["a", "b"]
    assert one["feed", "One"].tags == ["t", "c"] and one["feed", "One"].published_at == datetime(2024, 1, 19, 10) and one["next", "new a"].theme_section == "pc"
    filled = {r.title: (r.backfill, r.published_at) for r in landed.backfill_times(df, responses, 2).collect()}
    assert filled["first"] == ("filled", datetime(2024, 1, 18)) and filled["second"] == ("no_time", None) and filled["third"] == (None, None)
    assert read([]).collect() == []


def test_late_reposts_have_a_table_of_their_own(spark, tmp_path):
    """A late file: nothing is lost, reposts and stragglers are set apart, a replayed batch leaves one copy."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", late.PROVIDER)
    schema = "url string, at timestamp, is_update boolean"
    day = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    files = [[("a", day(0), False), ("b", day(0), False)], [("a", day(1), False), ("a", day(5), False), ("b", day(5), True)], [("b", day(1), False), ("c", day(2), None), (None, day(2), False), ("a", day(5), False)]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        found = late.sightings(stream, F.col("url"), F.col("at"), F.col("is_update"))
        late.write_routes(found, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    rows = late.routed(spark, str(tmp_path / "out")).collect()
    got = sorted((r.memory_key, r.ts, r.memory_status, r.route) for r in rows)
    assert got == [
        ("a", day(0), "new_story", "sighting"), ("a", day(1), "known_recent_story", "sighting"), ("a", day(5), "late_repost", "late"), ("a", day(5), "late_repost", "late"),
        ("b", day(0), "new_story", "sighting"), ("b", day(1), "known_recent_story", "late"), ("b", day(5), "follow_up_update", "sighting"), ("c", day(2), "new_story", "sighting"),
    ]
    assert {json.loads(r.row)["url"] for r in rows} == {"a", "b", "c"} and i == 2
    batch = spark.createDataFrame([(1, "x"), (2, "y")], "n int, s string")
    for _ in range(2):
        late.append_once(batch, 7, str(tmp_path / "once"))
    late.append_once(batch.limit(0), 8, str(tmp_path / "once"))
    assert sorted((r.n, r.batch_id) for r in spark.read.parquet(str(tmp_path / "once")).collect()) == [(1, 7), (2, 7)]


def test_contracts_of_odd_artifacts(spark):
    rows = [
        (1, "documents", "documents.json", True, '[{"candidate_url": "u", "title": " ", "source_id": null, "content": []}, 5, {}]'), (2, "documents", "documents.json", True, "{"), (3, "documents", "documents.json", True, "{}"), (4, "documents", "documents.json", True, None), (5, "documents", "documents.json", True, "[]"),
        (6, "documents", "documents.json", False, None), (7, "assets", "assets.json", False, None), (8, "story_clusters", "x.json", True, "not json"), (9, "unknown", "u.json", True, "{}"), (10, "content_review", "review.md", True, "# text"),
        (11, "run_manifest", "m.json", True, '{"run_id": 0, "status": "ok", "artifact_index": {}}'), (12, "run_manifest", "m.json", True, "[1]"), (13, "candidates", "c.json", True, '[{"title": "t", "url": "u", "source_id": "s", "published_at": "", "event_time": "x"}, {"title": "t", "url": "u", "source_id": "s"}]'),
    ]
    files = spark.createDataFrame([("r", *r) for r in rows], "run_id string, file_id long, artifact_key string, file_name string, present boolean, body string")
    rules = contracts.contracts(spark)
    bad = [(r.file_id, r["index"], r.error, r.fields and r.fields[0]) for r in contracts.violations(files.where("file_id in (1, 13)"), rules).collect() if r["index"] is not None]
    item = lambda i, *fields: [(1, i, "missing_field", f) for f in fields]
    assert sorted(bad, key=str) == sorted([(1, 0, "empty_field", "title"), (1, 0, "empty_field", "source_id"), (1, 1, "invalid_item_type", None), *item(2, "candidate_url", "title", "source_id", "content"), (13, 1, "missing_alternative_field", "published_at")], key=str)
    report = contracts.schema_report(files, rules)
    got = {r.file_id: (r.valid, r.skip_reason, r.errors, r.record_count) for r in report.collect()}
    assert got[2] == (False, "", ["json_parse_error"], None) == got[4] and got[3] == (False, "", ["unexpected_type"], 1) and got[5] == (True, "", [], 0)
    assert got[6] == (False, "", ["file_not_found"], None) and got[7] == (True, "missing_optional_artifact", [], None) and got[8] == (True, "", [], None)
    assert got[9][:2] == (True, "no_schema_registered") and got[10][:2] == (True, "unsupported_artifact_format") and got[11] == (True, "", [], 1) and got[12] == (False, "", ["invalid_item_type"], 1)
    total = contracts.report_summary(report).collect()[0]
    assert (total.total_artifacts_checked, total.valid, total.invalid, total.skipped, total.skipped_missing) == (13, 3, 7, 4, 2)
    notes = contracts.validation_notifications(report).collect()
    assert len(notes) == 6 and all(n.issue_id == "SCHEMA-001" and n.severity == "warning" for n in notes) and len({n.notification_id for n in notes}) == 6
    assert contracts.schema_report(files.limit(0), rules).collect() == []


def test_artifacts_are_judged_where_they_stand(spark):
    """No row of an item or a field is shuffled, and a body that no contract of a list or an object fits has the same error as before."""
    rows = [(1, "documents", "null"), (2, "run_manifest", "null"), (3, "run_manifest", '"x"'), (4, "documents", '[{"candidate_url": {}, "title": [], "source_id": 0, "content": "x"}, null, []]'), (5, "run_manifest", '{"run_id": null, "artifact_index": false}')]
    files = spark.createDataFrame([("r", True, f"{k}.json", *r) for k, r in zip("abcde", rows, strict=True)], "run_id string, present boolean, file_name string, file_id long, artifact_key string, body string")
    found = {(r.file_id, r["index"], r.rule_no, r.error) for r in contracts.violations(files, contracts.contracts(spark)).collect()}
    assert found == {(1, None, None, "unexpected_type"), (2, 0, None, "invalid_item_type"), (3, 0, None, "invalid_item_type"), (4, 1, None, "invalid_item_type"), (4, 2, None, "invalid_item_type"), (5, 0, 0, "empty_field"), (5, 0, 1, "missing_field")}
    report = contracts.schema_report(files, contracts.contracts(spark))
    assert {r.file_id: (r.n_errors, r.record_count) for r in report.collect()} == {1: (1, None), 2: (1, None), 3: (1, None), 4: (2, 3), 5: (2, 1)}
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "file_id" not in "".join(line for line in plan.splitlines() if "Join" in line)


def test_heat_observations_of_odd_bodies(spark):
    contract = [{"provider_id": "p", "platform": "weibo", "access_method": "API", "output_schema": {"url": {"source": "link", "default": "none"}, "snippet": "text", "likes": {}}}, {"provider_id": "q", "access_method": "nonsense"}]
    bodies = [("p", '{"link": " u ", "text": "t", "likes": 3, "engagement_signals": {"n": "2.5"}, "evidence_texts": ["My Game reply", " "], "candidate_title": "My Game"}'), ("p", '{"link": null}'), ("q", "[1]"), ("q", None), ("z", '{"url": "v", "platform": "own", "top_results": [{"title": "game"}, 5]}')]
    raw = spark.createDataFrame([(i, p, b) for i, (p, b) in enumerate(bodies)], "obs_id int, provider_id string, body string")
    got = {r.obs_id: r for r in heat.normalized(raw, heat.mapping(spark, contract), heat.providers(spark, contract), F.lit("2024")).collect()}
    assert (got[0].url, got[0].snippet, got[0].platform, got[0].access_method, got[0].extra, got[0].heat_validity_hint) == ("u", "", "weibo", "api_or_search_service", {"likes": "3"}, "general_social_heat")
    assert (got[1].url, got[1].timestamp, got[1].evidence_texts, got[1].heat_validity_hint) == ("none", "2024", [], "unclear")
    assert got[2].platform == got[3].platform == "unknown" and got[2].access_method == "public_search" and (got[4].platform, got[4].url) == ("own", "v") and len(got) == 5
    body = spark.createDataFrame([('{"platform": "x", "result_type": "r", "url": "u", "snippet": "s", "timestamp": "t", "engagement_signals": {}}',), ('{"url": " ", "engagement_signals": []}',), ("5",), (None,)], "b string")
    assert [r[0] for r in body.select(heat.missing_fields(F.col("b"))).collect()] == [[], heat.REQUIRED, heat.REQUIRED, heat.REQUIRED]
    access = heat.provider_access(spark.createDataFrame([("a", "ok", ""), ("b", "js_shell", ""), ("c", "403", "api_or_search_service"), ("d", "", ""), ("e", None, None), ("", "ok", "")], "platform string, public_http_probe string, default_access_mode string"), ["d"])
    assert [(r.access_status, r.recommended_method, r.requires_login) for r in access.collect()] == [("public_accessible", "public_search", False), ("login_required", "manual_or_browser_required", True), ("blocked", "api", True), ("login_required", "manual_or_browser_required", True), ("public_accessible", "public_search", False), ("blocked", "manual_or_browser_required", True)]
    assert heat.heat_summary(spark.createDataFrame([], "platform string, access_mode string, status string, heat_validity_hint string")).where("n > 0").collect() == []


def test_best_match_equals_all_pairs(spark):
    """Hosts and words that half of the rows share, bare paths, entities, equal URLs and rows without any key."""
    rng = random.Random(11)
    words = ["common", "common", "shared", "zelda", "mario", "metroid", "kirby", "patch", "trailer", "delay"]
    url = lambda: rng.choice(["", "https://big.x/" + "/".join(rng.sample(["a", "b", "c", "news"], rng.randint(0, 3))), f"https://h{rng.randint(0, 3)}.x/{rng.choice(['', 'a/b', 'news'])}"])
    row = lambda i: (i, url(), " ".join(rng.sample(words, rng.randint(0, 5))), rng.choice([None, [], ["e1"], ["e1", "e2"], ["e3"]]))
    schema = "id long, url string, title string, entities array<string>"
    c, m = (spark.createDataFrame([row(i) for i in range(n)], schema) for n in (60, 80))
    pairs = matching._shape(c, "c").crossJoin(matching._shape(m, "m")).withColumn("score", matching.match_score())
    want = {}
    for r in pairs.collect():
        if r.score >= 0.3 and (r.c_id not in want or (-r.score, r.m_id) < want[r.c_id]):
            want[r.c_id] = (-r.score, r.m_id)
    got = matching.best_matches(c, m)
    rows = got.collect()
    assert {r.candidate_id: (-r.score, r.memory_id) for r in rows if r.memory_id is not None} == want and len(rows) == 60 and 20 < len(want) < 60
    assert matching.match_stats(got).collect()[0].checked == 60
    assert [tuple(r) for r in matching.best_matches(c.limit(1), m.limit(0)).collect()] == [(c.first().id, None, None, "distinct")]


def test_packs_of_stories(spark):
    schema = "urls array<string>"
    packs_ = spark.createDataFrame([(i, ["https://hot/", f"https://p/{i}"]) for i in range(50)] + [(50, None), (51, ["ftp://x"])], f"pack_no int, {schema}")
    stories = spark.createDataFrame([(0, ["https://p/7", "https://hot/"]), (1, ["https://p/9", "https://p/3", "https://p/5"]), (2, ["ftp://x"]), (3, None), (99, ["https://none/"])], f"story_no int, {schema}")
    got = sorted(map(tuple, matching.matching_packs(stories, packs_).collect()))
    assert got == [(0, 0, "url"), (0, 1, "url"), (1, 3, "url"), (1, 5, "url"), (2, 2, "position"), (3, 3, "position")]


def test_replacements_equal_a_plain_loop(spark):
    rng = random.Random(2)
    pool = [(i, rng.choice(["", None, *"abcdefghijklmnop"]), rng.choice(["pc", "pc", "sony", "", None]), rng.choice([None, 1.0, 2.0, 3.0, float(rng.randint(0, 9))])) for i in range(200)]
    stories = [(0, "pc"), (1, "sony"), (2, ""), (3, None), (4, "other"), (5, " pc ")]
    want = set()
    for story, theme in stories:
        t, seen, fit = (theme or "").strip(), set(), []
        for no, key, own, heat_ in pool:
            if (not t or not (own or "") or own == t) and (not key or key not in seen):
                seen.add(key)
                fit.append((-(heat_ or 0.0), no))
        want |= {(story, k, no) for k, (_, no) in enumerate(sorted(fit)[:8], 1)}
    df = matching.replacements(spark.createDataFrame(stories, "story_id int, theme_section string"), spark.createDataFrame(pool, "candidate_no int, key string, theme_section string, heat_score double"), salts=3)
    assert set(map(tuple, df.collect())) == want
    flags = spark.createDataFrame([("Weibo", None), ("x", "https://www.GAMERSKY.com/a"), (None, "https://a.example")], "s string, u string")
    assert [r[0] for r in flags.select(matching.is_chinese(F.col("s"), F.col("u"))).collect()] == [True, True, False]


@pytest.mark.parametrize(("text", "want"), [("5m", timedelta(minutes=5)), ("posted 2 weeks ago", timedelta(weeks=2)), ("今天 08:00", timedelta(hours=12)), ("1-19 20:00", timedelta(days=1)), ("2024年1月20日 20:00", timedelta())])
def test_listing_times(text, want):
    assert NOW - listing.time_in(text, NOW) == want
    assert listing.time_in("2024-13-41 99:00", NOW) is None


def test_trace_is_recorded_once(spark, tmp_path):
    """Events keep their numbers when a batch is replayed after later ones; decisions are one row each."""
    from newsloom.streaming import trace

    at = lambda h: datetime(2024, 1, 1, h)
    schema = "run_id string, event_type string, created_at timestamp, event_no long, details map<string,string>"
    one = spark.createDataFrame([("r", "run_started", at(0), 0, None), ("r", "node", at(1), 2, {"k": "v"}), ("r", "node", at(1), 1, {}), ("s", "run_started", at(0), 0, None)], schema)
    two = spark.createDataFrame([("r", "run_done", at(2), 0, None)], schema)
    path = str(tmp_path / "events")
    write = trace.event_sink(path)
    for batch, no in ((one, 0), (two, 1), (one, 0), (two, 1)):
        write(batch, no)
    got = sorted((r.run_id, r.event_id, r.event_type, r.details) for r in spark.read.parquet(path).collect())
    assert got == [("r", "evt_00001", "run_started", "{}"), ("r", "evt_00002", "node", "{}"), ("r", "evt_00003", "node", '{"k":"v"}'), ("r", "evt_00004", "run_done", "{}"), ("s", "evt_00001", "run_started", "{}")]
    decisions = spark.createDataFrame([("r", "rank", "keep", None, {"a": "1"}, None, None)] * 2, "run_id string, stage string, decision_type string, input_artifact_refs array<string>, output_decision map<string,string>, model_used string, prompt_version string")
    log = trace.decision_sink(str(tmp_path / "decisions"), F.lit("2024"))
    log(decisions, 3)
    log(decisions, 3)
    assert [(r.stage, r.output_decision, r.batch_id) for r in spark.read.parquet(str(tmp_path / "decisions")).collect()] == [("rank", '{"a":"1"}', 3)]


def test_notifications_with_lists(spark):
    from newsloom.operators import newsroom

    row = lambda i, severity, actions, details: (f"notif_{i:012x}", "RUN-006", "s", severity, "open", "t", "m", actions, details)
    rows = [row(1, "needs_user_action", '["do"]', "{}"), row(2, "odd", '["do", 5, null]', "[]"), row(3, "info", '"do"', None), row(4, "info", None, "x")]
    df = spark.createDataFrame(rows, "notification_id string, issue_id string, stage string, severity string, status string, title string, message string, suggested_actions string, details string")
    got = sorted((int(r.notification_id[-1]), r.issue) for r in newsroom.notification_issues(df).collect())
    assert got == [(2, "invalid:severity"), (2, "not_a_text:suggested_actions[1]"), (2, "not_a_text:suggested_actions[2]"), (2, "not_an_object:details"), (3, "not_a_list:suggested_actions"), (4, "not_an_object:details")]


def test_requests_are_one_for_each_claim_and_url(spark):
    from newsloom.operators import probes, requests, review

    cands = spark.createDataFrame([(0, "u", "a", "general_tech"), (1, "u", "b", "general_tech"), (2, "", "c", "manual_review"), (3, None, "c", "manual_review"), (4, "v", "d", "news")], "ordinal long, url string, title string, candidate_type string")
    cands = cands.selectExpr("*", "'' AS snippet", "'main' AS candidate_lane", "0.0D AS discussion_score")
    assert [(r.ordinal, r.request_no) for r in probes.judgment_requests(cands, "ordinal").orderBy("ordinal").collect()] == [(0, 1), (2, 2)]
    evidence = "array<struct<chunk_id:string>>"
    claims = spark.createDataFrame([("c1", "s", "t", "likely", [("own",)]), ("c2", "s", "t", "likely", [("own",)]), (None, "s", "t", "rumor", None)], f"claim_id string, story_id string, text string, check_status string, evidence {evidence}")
    packs_ = spark.createDataFrame([("c1", [("pack",)]), ("c2", [])], f"candidate_id string, evidence {evidence}")
    got = sorted((r.request_id, [e.chunk_id for e in r.evidence or []]) for r in requests.verification_requests(claims, packs_).collect())
    assert got == [("c1", ["pack"]), ("c2", ["own"]), ("s", [])]
    answers = spark.createDataFrame([(1, "query-compression-r", '{"queries": ["old"]}'), (2, "query-compression-r", "broken")], "answer_no int, request_id string, raw_response string")
    asked = spark.createDataFrame([("r", "long query")], "request_id string, query string")
    assert [r.query_source for r in requests.with_compressed_queries(asked, answers).collect()] == ["fallback"]
    assert [r.query for r in requests.with_compressed_queries(asked, answers.drop("answer_no")).collect()] == ["old"]
    verdicts = spark.createDataFrame([("a", "parsed", "rumor", 0.5), ("a", "parsed", "likely", 0.5)], "request_id string, parse_status string, check_status string, confidence double")
    rules = spark.createDataFrame([("a", "reject", 0.1)], "request_id string, check_status string, confidence double")
    assert [r.check_status for r in review.applied_verdicts(rules, verdicts).collect()] == ["likely"]
