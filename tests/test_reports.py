"""The content-quality report of odd runs, and timelines of clusters with their claims."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from newsloom.operators import events, quality


def _run(spark, **rows):
    schema = {
        "candidates": "source_id string, has_heat boolean, has_discussion boolean", "stories": "source_urls array<string>, has_rumor boolean", "posts": "has_rumor boolean, asset_status string", "health": "status string",
    }
    return {k: spark.createDataFrame(v, schema.get(k, "x int")) for k, v in rows.items()}


def test_empty_run_is_told_so(spark):
    m = quality.metrics(_run(spark, candidates=[], stories=[], posts=[], documents=[], verifications=[]))
    r = quality.report(m).collect()[0]
    # no sources or candidates, nothing to fetch, verify or select; posts are not needed without stories
    assert (r.gate_status, r.readiness, r.issues, r.overall_score) == ("needs_review", "ready_for_content_review", ["no_main_candidates"], 5)
    assert [r[s] for s in quality.WEIGHTS] == [0, 0, 0, 0, 0, 50]
    assert {x.stage: x.status for x in quality.stage_scores(m, 40, 20).collect()}["platform_packaging"] == "pass"


def test_good_and_blocked_runs(spark):
    n = [(1,)] * 20
    good = _run(spark, candidates=[(f"s{i % 10}", True, True) for i in range(20)], rejected=n[:1], documents=n, verifications=n, stories=[([f"https://www.a{i}.x/1"], False) for i in range(8)], posts=[(False, "ready")] * 8, llm_requests=n, llm_results=n, health=[("healthy",)] * 5)
    r = quality.report(quality.metrics(good)).collect()[0]
    assert (r.gate_status, r.readiness, r.issues) == ("pass", "ready_for_layout", []) and r.overall_score >= 85
    bad = _run(
        spark, candidates=[("s", False, False), (" ", None, None), (None, False, False), ("s", False, False)], documents=n[:1], verifications=n, stories=[(["https://www.a.x/1"], True), (["https://a.x/2"], False), ([], False)], posts=[(True, "manual_fill_required")] * 2, llm_requests=n[:2], health=[("source_broken",), ("needs_fill",)]
    )
    m = quality.metrics(bad)
    r = quality.report(m).collect()[0]
    assert r.gate_status == r.readiness == "blocked"
    assert r.issues == ["source_collection_blocked", "low_discussion_signal_coverage", "no_llm_verification_results", "rumor_without_llm_verification", "limited_document_fetch", "manual_assets_required"]
    one = m.collect()[0]
    assert (one.candidate_share, one.story_share, one.document_fetch_coverage, one.manual_asset_ratio) == (0.5, 0.6667, 0.25, 1.0)
    assert quality.metrics(bad, pool_fetched=2).collect()[0].document_fetch_coverage == 0.5
    stages = {x.stage: (x.score, x.criteria) for x in quality.stage_scores(m).collect()}
    assert stages["claim_verification"] == (35, {"rule_verification_coverage": 100, "llm_or_manual_coverage": 0, "rumor_safety": 0}) and stages["evidence_fetch"][0] == 20


def test_timelines_of_clusters(spark):
    at = lambda d: datetime(2024, 1, d)
    clusters = [
        ("c1", "Zelda announced", ["Zelda", "zelda "], None, None), ("c2", "Zelda confirmed", ["zelda"], None, at(3)), ("c3", "Zelda revealed, correction", ["ZELDA"], ["x"], at(2)), ("c4", "plain", None, None, None), ("c5", None, [], ["Clarify"], at(1)), ("c6", "plain too", [" "], None, at(4)),
    ]
    cl = spark.createDataFrame(clusters, "story_cluster_id string, canonical_title string, entity_signatures array<string>, tags array<string>, published_at timestamp").withColumns({"source_urls": F.array(F.lit("u")), "candidate_count": F.lit(1)})
    claims = spark.createDataFrame([("c4", 2, "b", "rumor", at(9), None), ("c4", 1, "a", "news", None, 7.0), ("c2", 1, "a", None, at(8), 3.0), ("", 1, "a", "rumor", None, None)], "story_id string, claim_no int, claim_id string, candidate_type string, published_at timestamp, heat_score double")
    timelines, entries = events.cluster_timelines(cl, claims)
    rows = {r.story_cluster_id: r for r in entries.collect()}
    zelda = [(i, rows[i].chronological_index, rows[i].event_label) for i in ("c1", "c3", "c2")]
    assert zelda == [("c1", 0, "initial_report"), ("c3", 1, "correction"), ("c2", 2, "official_confirmation")]
    assert len({rows[i].event_id for i in ("c1", "c2", "c3")}) == 1 and rows["c2"].published_at == at(3) and rows["c2"].heat_score == 3.0
    assert [(rows[i].chronological_index, rows[i].event_label, rows[i].claim_count, rows[i].candidate_type) for i in ("c4", "c5", "c6")] == [(0, "initial_report", 2, "news"), (1, "correction", 0, "news"), (2, "new_detail", 0, "news")]
    t = {r.event_key.split(":")[2]: r for r in timelines.collect()}
    assert (t["confirmed_report"].timeline_label, t["confirmed_report"].entry_count, t["confirmed_report"].started_at, t["confirmed_report"].last_updated_at) == ("Zelda / zelda  — 官方动态时间线", 3, None, at(3))
    assert t["general_news"].timeline_label == "未识别游戏 — 事件时间线" and t["general_news"].has_correction and not t["general_news"].has_official_confirmation
    assert events.cluster_timelines(cl.limit(0), claims)[0].collect() == []


def test_memory_equals_a_plain_loop(spark):
    """Two runs with explicit keys, URLs that differ in case and slashes, titles, blanks and repeats."""
    from newsloom.operators import memory

    at = lambda d: datetime(2024, 1, d)
    row = lambda i, key, url, title, source, when: (i, key, url, title, source, when, None)
    one = [row(0, None, "https://A.x/p/", "A", "s1", at(1)), row(1, " ", "https://a.x/p", " A ", "s2", at(1)), row(2, "story 7", "u", None, None, None), row(3, None, None, "Some Title!", "s1", None), row(4, None, " ", " !", "s1", at(2))]
    two = [row(0, None, "https://a.x/p//", "B", "", at(3)), row(1, None, "", "some title", "s3", at(1)), row(2, "new", "", "", "s9", None)]
    schema = "o int, memory_key string, url string, title string, source_id string, published_at timestamp, observed_at timestamp"
    records, want = spark.createDataFrame([], memory.RECORD), {}
    for run, now in ((one, at(10)), (two, at(11))):
        cands = spark.createDataFrame(run, schema)
        done = memory.updated_records(records, cands, "o", F.lit(now))
        stats = memory.update_stats(done, cands).collect()[0]
        new = met = skipped = 0
        for _, key, url, title, source, when, _ in run:
            u = (url or "").strip().lower().rstrip("/")
            k = (key or "").strip() or (f"url:{u}" if u else {"Some Title!": "t", "some title": "t"}.get(title, ""))
            if not k:
                skipped += 1
                continue
            new, met = new + (k not in want), met + (k in want)
            r = want.setdefault(k, [now, now, 0, [], [], [], [], "", "", ""])
            r[1], r[2] = now, r[2] + 1
            for i, v in ((3, (title or "").strip()), (4, (url or "").strip()), (5, (source or "").strip()), (6, when)):
                if v and v not in r[i]:
                    r[i].append(v)
            r[7:] = [(v or "").strip() or old for v, old in zip((title, url, source), r[7:], strict=True)]
        assert tuple(stats) == (len(want), new, met, skipped)
        records = spark.createDataFrame(done.drop("state").collect(), memory.RECORD)
    got = {("t" if r.memory_key.startswith("title:") else r.memory_key): list(r)[1:] for r in records.collect()}
    assert got == want and got["t"][2] == 2


def test_localization_and_synthetic_documents(spark, tmp_path):
    from newsloom import sources
    from newsloom.operators import matching

    ev = "array<struct<source_id:string,title:string,quote:string>>"
    rows = [(0, "1", "T", "EN ", "", "pc", [(None, None, " "), ("s", "t", " q ")]), (1, None, "by title", "", "original_source_used", None, None), (2, "3", "zh", "zh", "original_source_used", "pc", None), (3, " ", " ", "en", "", "pc", None), (4, "5", "x", "fr", "", "pc", None)]
    stories = spark.createDataFrame(rows, f"ordinal int, id string, title string, source_language string, source_preference string, theme_section string, evidence {ev}")
    pool = spark.createDataFrame([(0, "a", "pc", 1.0, "p", "u0", "weibo"), (1, "b", "sony", 9.0, "q", "u1", "weibo"), (2, "c", None, None, None, "https://www.bilibili.com/x", None), (3, "d", "pc", 5.0, "r", "u3", "ign")], "candidate_no int, key string, theme_section string, heat_score double, title string, url string, source_id string")
    got = {r.story_id: r for r in matching.localization_requests(stories, pool, spark.createDataFrame([("1",)], "id string")).collect()}
    assert set(got) == {"1", "by title"} and got["1"].selected_final_story and [tuple(q) for q in got["1"].evidence_quotes] == [("s", "t", "q")]
    assert [c.url for c in got["1"].candidate_replacements] == ["u0", "https://www.bilibili.com/x"] and [c.url for c in got["by title"].candidate_replacements] == ["u1", "u0", "https://www.bilibili.com/x"]
    assert matching.localization_requests(stories, pool.limit(0), limit=1).collect()[0].candidate_replacements == []
    cands = spark.createDataFrame([(1, "u", "t", " s ", "a"), (0, "v", None, "", None), (2, "w", "z", None, "b")], "o int, url string, title string, snippet string, source_id string").selectExpr("*", "cast(null AS timestamp) AS published_at", "timestamp'2024-01-01' AS observed_at")
    docs = sources.synthetic_documents(cands, F.current_timestamp(), "o", 2).collect()
    assert [(r.candidate_url, r.title, r.content, r.source_id) for r in docs] == [("v", "v", "", ""), ("u", "t", "t\n s", "a")]
    sources.write_json(cands.repartition(2).select("o", "url"), str(tmp_path / "j"))
    assert sorted(map(tuple, sources.read_json(spark, str(tmp_path / "j"), "o int, url string").collect())) == [(0, "v"), (1, "u"), (2, "w")]
    sources.write_json(cands.limit(0), str(tmp_path / "e"))
    assert sources.read_json(spark, str(tmp_path / "e"), "o int").collect() == []
