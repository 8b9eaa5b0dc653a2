"""How many rows the joins make: they must not grow with the square of what shares a key."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsloom.operators import clusters, evidence, matching, newsroom
from newsloom.sources import landed


def _nodes(plan):
    yield plan
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from _nodes(plan.plan())
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def _collected(df):
    """The rows of ``df``, and the most rows that one of its joins made."""
    rows = df.collect()
    made = [0]
    for node in _nodes(df._jdf.queryExecution().executedPlan()):
        if "Join" in node.getClass().getSimpleName() and node.metrics().contains("numOutputRows"):
            made.append(node.metrics().apply("numOutputRows").value())
    return rows, max(made)


def _stories_and_assets(spark):
    stories = spark.range(100).select(F.col("id").alias("story_id"), F.lit("t").alias("title"), F.lit("ready").alias("status"), F.lit("verified").alias("internal_status"), F.lit(1.0).alias("story_score"), F.array(F.lit("u0"), F.lit("u1")).alias("source_urls"))
    assets = spark.range(600).select(F.concat(F.lit("u"), (F.col("id") % 3).cast("string")).alias("source_url"), F.lit("img").alias("url"), F.when(F.col("id") == 1, "available").otherwise("pending").alias("status"), F.col("id").alias("asset_no"))
    return stories, assets


def test_assets_meet_stories_without_their_repeats(spark):
    rows, made = _collected(newsroom.story_assets(*_stories_and_assets(spark)))
    assert sorted((r.story_id, r.source_url, r.url, r.status, r.asset_no) for r in rows) == sorted((i, f"u{k}", "img", ("pending", "available")[k], k) for i in range(100) for k in (0, 1))
    assert made == 200


def test_posts_meet_source_urls_with_a_picture(spark):
    rows, made = _collected(newsroom.platform_posts(*_stories_and_assets(spark)))
    assert len(rows) == 100 and {r.asset_status for r in rows} == {"available"}
    assert made <= 100


def test_paths_meet_once(spark):
    """Pages of one host whose paths share three words: a pair is made at one of them, in blocks as in one group."""
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.concat(F.lit("https://h.x/a/b/c/"), F.col("id").cast("string")).alias("u"))
    want = {(i, j, 0.6) for i in range(60) for j in range(i + 1, 60)}
    for block in (512, 7):
        rows, made = _collected(clusters.path_pairs(pages, "page_id", F.col("u"), 0.3, block))
        assert {tuple(r) for r in rows} == want and len(rows) == len(want)
        assert made <= 2 * len(want)
    plan = clusters.path_pairs(pages, "page_id", F.col("u"), 0.3)._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("Join")]
    assert "Aggregate" not in top  # pairs are not collected again to find repeats


def test_common_title_words_are_no_keys(spark):
    """Titles that share two frequent words of five on different hosts are no match and don't meet; equal titles meet the first."""
    row = lambda p: spark.range(40).select(F.col("id"), F.concat(F.lit(f"https://{p}"), F.col("id").cast("string"), F.lit(".x/q")).alias("url"), F.concat(F.lit("common shared "), *(x for k in "xyz" for x in (F.lit(f"{k}{p}"), F.col("id").cast("string"), F.lit(" ")))).alias("title"), F.array(F.lit("en")).alias("entities"))
    rows, made = _collected(matching.best_matches(row("c"), row("m")))
    assert [r.band for r in rows] == ["distinct"] * 40 and made <= 400
    rows, _ = _collected(matching.best_matches(row("c"), row("c").unionByName(row("c").withColumn("id", F.col("id") + 100)), block=3))
    assert sorted((r.candidate_id, r.memory_id, r.score) for r in rows) == [(i, i, 1.0) for i in range(40)]


def test_token_pairs_are_not_shuffled(spark):
    """Pairs of sets are decided where they meet: no shuffle to find those that met more than once."""
    df = spark.range(40).select("id", F.split(F.concat_ws(" ", *(F.lit(w) for w in "abcdefgh"), F.col("id").cast("string")), " ").alias("w"))
    found = clusters.token_pairs(df, "id", F.col("w"), F.lit("x"), 0.65)
    assert {tuple(r) for r in found.collect()} == {("x", i, j, 0.8) for i in range(40) for j in range(i + 1, 40)}
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_look_up_reads_a_small_row_group(spark, tmp_path):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.xxhash64("id", i).cast("string")))
    landed.land(spark.range(500).select(F.concat(F.lit("https://x/"), F.col("id").cast("string")).alias("url"), text.alias("text")), str(tmp_path / "l"), parts=1)
    landing = landed.Landing(str(tmp_path / "l"), parts=1)
    assert landing.get("https://x/77")["url"] == "https://x/77" and landing.get("https://x/none") is None
    assert max(g.row_groups[0].num_rows for g in landing.held[0]) < 250


def test_pages_of_a_node_read_each_row_group_about_once(spark, tmp_path, monkeypatch):
    """Consecutive pages lie in few row groups, which are kept; every look-up gives what was landed, also one of a URL that wasn't."""
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.xxhash64("id", i).cast("string")))
    path, url = str(tmp_path / "l"), lambda i: f"https://x/page={1000 + i}"
    landed.land(spark.range(900).select(F.concat(F.lit("https://x/page="), (F.col("id") + 1000).cast("string")).alias("url"), text.alias("text")), path, parts=2)
    landing, reads = landed.Landing(path, parts=2), []
    read = landing._row_groups
    monkeypatch.setattr(landing, "_row_groups", lambda where: [type("G", (), {"row_groups": g.row_groups, "to_table": lambda self, g=g, **k: reads.append(g) or g.to_table(**k)})() for g in read(where)])
    assert [landing.get(url(i))["url"] for i in range(900)] == [url(i) for i in range(900)]
    assert landing.get("https://x/a") is None and landing.get("https://x/page=10005") is None and landing.get("https://y") is None
    groups = sum(map(len, landing.held.values()))
    assert groups > 4 and len(reads) <= groups + 3


@pytest.mark.parametrize("block", [256, 7])
def test_bm25_makes_no_row_for_a_pair(spark, block):
    """Queries that share a word with all documents; texts and ids that are null, empty and repeated count as in a plain loop."""
    texts = {i: f"shared w{i % 7} w{i % 11} " + "w3 " * (i % 4) + "filler " * (i % 5) for i in range(300)} | {300: None, 301: "", 302: "the of", None: "shared w3"}
    asks = [(i, f"shared shared w{i % 7} the w{i % 11}") for i in range(40)] + [(5, "shared w1"), (40, None), (41, "nowhere"), (None, "w3")]
    docs, queries = spark.createDataFrame(list(texts.items()), "d long, t string").repartition(3), spark.createDataFrame(asks, "q long, t string")
    split = {d: [w for w in (t or "").split() if w not in ("the", "of")] for d, t in texts.items()}
    n, avgdl, df = len(split), sum(map(len, split.values())) / len(split), Counter(w for ws in split.values() for w in set(ws))
    asked = Counter((q, w) for q, t in asks for w in set((t or "").split()) if w in df)
    want = set()
    for q in {q for q, _ in asked}:
        score = lambda ws: sum(times * math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * ws.count(w) * 2.2 / (ws.count(w) + 1.2 * (0.25 + 0.75 * len(ws) / avgdl)) for (p, w), times in asked.items() if p == q)  # noqa: E731, B023
        best = sorted((-round(score(ws), 9), d is not None, d or 0, d) for d, ws in split.items() if score(ws) > 0)[:5]
        want |= {(q, b[3], round(-b[0], 6), i + 1) for i, b in enumerate(best)}
    rows, made = _collected(evidence.bm25(docs, "d", F.col("t"), queries, "q", F.col("t"), block=block))
    assert {(r.q, r.d, round(r.score, 6), r["rank"]) for r in rows} == want and len(rows) == len(want)
    assert made < 1000
