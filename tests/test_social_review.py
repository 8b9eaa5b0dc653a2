"""Search results, social observations, cluster review, verdicts and history."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.operators import review, social

NOW = datetime(2026, 5, 11, 10)


@pytest.mark.parametrize(
    ("title", "hours", "label"),
    [
        ("《塞尔达传说》 gamescom 新消息", 1, "same_event_same_game"), ("《塞尔达传说》 other", 99, "old_news"), ("《塞尔达传说》 gamescom trailer reveal today", 1, "same_event_same_game"), ("《塞尔达传说》 elsewhere", 1, "same_game_different_event"),
        ("you won't believe it", 1, "clickbait_title"), ("cooking", 1, "unrelated"), ("trailer reveal today", 1, "repost"),
    ],
)
def test_search_result_labels(spark, title, hours, label):
    candidate = "trailer reveal today" if label == "repost" else "《塞尔达传说》 gamescom trailer reveal"
    df = spark.createDataFrame([(title, candidate, NOW - timedelta(hours=hours))], "t string, c string, p timestamp")
    assert df.select(social.result_label(F.col("t"), F.col("t"), F.col("c"), F.col("p"), F.lit(NOW)).alias("r")).first().r.label == label


def test_regions_and_targets(spark):
    df = spark.createDataFrame([("ZH", "ign", "", "a b"), (None, "famitsu", "", "x"), ("", "", "https://www.ign.com/1", "y"), (None, None, None, None)], "lang string, src string, url string, q string")
    df = df.withColumn("region", social.heat_region(F.col("lang"), F.col("src"), F.col("url")))
    assert [r.region for r in df.collect()] == ["zh_cn", "ja_jp", "en_global", "global"]
    got = {(r.region, r.platform): (r.target_url, r.access) for r in social.search_targets(df, "q").collect()}
    assert len(got) == 16 and got["zh_cn", "weibo"] == ("https://s.weibo.com/weibo?q=a+b", "public_search_page") and got["zh_cn", "xiaoheihe"] == ("", "manual_app_probe_required")


def test_queries_are_compressed(spark):
    df = spark.createDataFrame([("《A》 on PS5 at gamescom, Xbox",), ("plain " + "word " * 40,), ("x" * 120,)], "t string")
    got = [r[0] for r in df.select(social.compressed_queries(F.col("t"), F.lit(""))).collect()]
    assert got[0] == ["A gamescom", "A PS5", "A Xbox"] and len(got[1][0]) <= 96 and got[1][0].endswith("word") and got[2] == ["x" * 96]


def test_observation_status(spark):
    df = spark.createDataFrame([("public_search_page", "ok", None), ("manual app", "missing_url", None), ("", "?", 401), (None, None, 429), ("api", "skipped", None)], "access string, status string, status_code int")
    got = [(r.access_mode, r.status) for r in social.observations(df).collect()]
    assert got == [("public_search", "ok"), ("manual_import", "manual_required"), ("public_search", "login_required"), ("public_search", "blocked"), ("api_or_search_service", "error")]


def test_relevance_takes_echoes_out(spark):
    rows = [("Zelda trailer", "", "Zelda trailer", "", ""), ("Zelda trailer", "", "Zelda is great, 3 hours ago", "https://youtu.be/1", ""), ("Zelda trailer", "", "new zelda 预告 2019", "", ""), ("Zelda", "", "cats", "", "")]
    df = spark.createDataFrame(rows, "title string, snippet string, result_text string, result_url string, query string")
    got = [(r.deterministic_status, r.time_hint, r.result_type, r.requires_semantic_review) for r in social.relevance(df, {"zelda": ["zelda", "塞尔达"]}).collect()]
    assert got == [("unknown", "unknown_time", "unknown", False), ("same_platform_only", "within_window", "video", False), ("same_game_unclear_event", "outside_window", "unknown", False), ("off_topic", "unknown_time", "unknown", False)]


def test_cluster_roles_and_votes(spark):
    t = NOW
    rows = [
        (1, "zelda new trailer shown today", ["https://a.x/1?x"], ["zelda"], t), (2, "another headline", ["https://a.x/1"], ["zelda"], t), (3, "zelda new trailer shown", ["https://b.x/2"], ["zelda"], t),
        (4, "why the reaction matters", ["https://c.x/3"], ["zelda"], t), (5, "zelda announced", ["https://nintendo.com/z"], ["zelda"], t), (6, "lonely", ["https://d.x"], ["other"], t),
    ]
    c = spark.createDataFrame(rows, "cluster_id int, title string, urls array<string>, entities array<string>, first_time timestamp")
    assert [(r.entity, r.clusters) for r in review.review_requests(c).collect()] == [("zelda", [1, 2, 3, 4, 5])]
    roles = review.cluster_roles(c)
    got = {(r.a, r.b): (r.role, r.confidence) for r in roles.collect()}
    assert got[1, 2] == ("duplicate_report", 0.95) and got[1, 3] == ("new_detail_after_announcement", 0.81) and got[1, 4][0] == "reaction_or_commentary" and got[1, 5] == ("official_confirmation", 0.82)
    assert len(got) == 10 and review.votes(roles).first().role in {"official_confirmation", "reaction_or_commentary"}


def test_verdicts(spark):
    rows = [("a", '{"check_status": "Likely", "confidence": 1.7}'), ("b", "```json\n{\"check_status\": \"reject\"}\n```"), ("c", "no"), ("d", '{"check_status": "maybe"}'), ("e", None), ("f", "[1]")]
    df = review.parsed_verdicts(spark.createDataFrame(rows, "request_id string, r string"), "r")
    assert [(x.parse_status, x.check_status, x.confidence) for x in df.orderBy("request_id").collect()] == [("parsed", "likely", 1.0), ("parsed", "reject", 0.0), ("invalid_json", None, None), ("invalid_status", None, None), ("invalid_json", None, None), ("invalid_json", None, None)]
    rules = spark.createDataFrame([("a", "reject", 0.1), ("c", "rumor", 0.4)], "request_id string, check_status string, confidence double")
    assert sorted((r.request_id, r.check_status, r.verified_by) for r in review.applied_verdicts(rules, df).collect()) == [("a", "likely", "model"), ("c", "rumor", "rules")]


def test_history(spark):
    s = spark.createDataFrame([(1, ["Zelda"], ["delay"])], "story_id int, entities array<string>, event_types array<string>")
    rows = [(i, ["zelda"] if i % 2 else ["x"], ["delay"] if i % 3 == 0 else [], datetime(2010 + i, 1, 1)) for i in range(12)]
    h = spark.createDataFrame(rows, "item_id int, entities array<string>, event_types array<string>, published_at timestamp")
    got = [r.item_id for r in review.related_history(s, h, 2014, 3).orderBy("rank").collect()]
    assert got == [11, 9, 7]
