"""Run tables, the query API, upserts and the streaming memory."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsloom import streaming
from newsloom.plans.store import RunStore, clamp, duplicates_across_runs, upsert


@pytest.fixture
def store(spark, tmp_path):
    s = RunStore(spark, str(tmp_path))
    for run, ended in (("r1", "2026-01-01"), ("r2", "2026-01-02")):
        s.ingest(run, "runs", spark.createDataFrame([("", ended)], "started_at string, ended_at string"))
        s.ingest(run, "stories", spark.createDataFrame([("a", "short", 1.0, "pc"), ("b", "a title long enough", 2.0, "pc")], "story_id string, title string, story_score double, theme_section string"))
        s.ingest(run, "candidates", spark.createDataFrame([("main", "c", 1, 5.0, "pc", "s"), ("main", "c", 2, 7.0, "pc", "s"), ("supplemental", "d", 3, 9.0, "", "s")], "lane string, candidate_id string, n int, heat_score double, theme_section string, source_id string").selectExpr("*", "'' AS published_at", "'' AS observed_at"), "n")
        s.ingest(run, "documents", spark.createDataFrame([("d1", ""), ("d2", "x")], "document_id string, content string"))
        s.ingest(run, "claims", spark.createDataFrame([("k", "t")], "claim_id string, text string"))
        s.ingest(run, "notifications", spark.createDataFrame([("n1", "error", "open"), ("n2", "warning", "done")], "notification_id string, severity string, status string"))
        s.ingest(run, "artifacts", spark.createDataFrame([("x", "s1", "p")], "artifact_key string, stage string, path string"))
    return s


def test_queries(store):
    assert store.latest() == "r2"
    assert [r.story_id for r in store.query("stories").collect()] == ["b", "a"]
    assert [(r.candidate_id, r.heat_score) for r in store.query("candidates", lane="main").collect()] == [("c", 7.0)]
    assert [r.severity for r in store.query("notifications").collect()] == ["warning", "error"]
    assert [r.flag for r in store.query("quality_flags").collect()] == ["short_title", "empty_document_content", "open_notification"]
    assert {r.table: r.n for r in store.query("run_summary").collect()}["open_notifications"] == 1
    with pytest.raises(ValueError):
        store.query("drop table")


def test_ingest_replaces_only_its_run(spark, store):
    store.ingest("r1", "claims", spark.createDataFrame([("new", "t")], "claim_id string, text string"))
    assert sorted((r.run_id, r.claim_id) for r in store.table("claims").collect()) == [("r1", "new"), ("r2", "k")]


def test_limits():
    assert [clamp(x) for x in (0, 1, 500, 501, None, "x")] == [1, 1, 500, 500, 20, 20]


def test_upsert(spark):
    old = spark.createDataFrame([("a", 5, "x", 2), ("b", 1, "y", 1)], "k string, seen int, v string, n int")
    new = spark.createDataFrame([("a", 9, "z", 3), ("c", 4, "w", 1)], "k string, seen int, v string, n int")
    assert sorted(map(tuple, upsert(old, new, "k", ["seen"], ["n"]).collect())) == [("a", 5, "z", 5), ("b", 1, "y", 1), ("c", 4, "w", 1)]


def test_cross_run_duplicates(spark):
    rows = [(1, "r1", "https://a.x/1", "one two three four"), (2, "r2", "https://a.x/2", "one two three five four"), (3, "r1", "https://a.x/3", "one two three four five six seven"), (4, "r2", "https://b.x/1", "one two three four")]
    df = spark.createDataFrame(rows, "candidate_no long, run_id string, url string, title string")
    assert sorted((r.id_a, r.id_b) for r in duplicates_across_runs(df).collect()) == [(1, 2), (2, 3)]


def test_memory_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"k{i % 7}" if i % 11 else None, datetime(2026, 1, 1 + i % 20)) for i in range(200)]
    df = spark.createDataFrame(rows, "n int, key string, ts timestamp")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    got = streaming.memory_of(spark, str(tmp_path / "in"), str(tmp_path / "cp"), "key", "ts", "seen_memory_test")
    want = df.where("key is not null").groupBy("key").agg(F.min("ts"), F.max("ts"), F.count("*"))
    assert sorted(map(tuple, got.select("memory_key", "first_seen_at", "last_seen_at", "seen_count").collect())) == sorted(map(tuple, want.collect()))
