"""Queries against plain versions of the whole job, on small tables."""

from __future__ import annotations

import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom import functions as fn
from newsloom import plans
from newsloom.operators import evidence

DOCS = [
    "zebra opens here, then the patch for the studio and the console follow",  # its first word is in no item
    "Studio news",
    "consoles-and-PATCHES in one text, a superstudio",
    "nothing shared at all",
    "",
    None,
    "发布新游戏机 and the 游戏机 patch",
]
ITEMS = ["Studio patch for the console", "游戏机 发布", "the of and", "after the patch", None]


def _words(text, stop):
    return {t for t in re.findall(r"[a-z0-9]+|[一-鿿]{2,}", (text or "").lower()) if len(t) > 1 and t not in stop}


def _claim_words(text):
    out = set()
    for t in _words(text, fn.CLAIM_STOPWORDS):
        out |= {t[i : i + 2] for i in range(len(t) - 1)} if "一" <= t[0] <= "鿿" else {t}
    return out


def _hits(words, text):
    return sum(w in (text or "").lower() for w in words)


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_keyword_retrieval_scores_every_document(spark, folder):
    want = set()
    for q, item in enumerate(ITEMS):
        best = sorted((-_hits(_words(item, fn.RETRIEVAL_STOPWORDS), t), d) for d, t in enumerate(DOCS))
        want |= {(q, d, -s, r) for r, (s, d) in enumerate([x for x in best if x[0]][:5], 1)}
    assert (0, 0, 3, 1) in want
    assert {tuple(r) for r in plans.QUERIES["keyword_retrieval"](spark, folder).collect()} == want


def test_claim_support_scores_every_pair(spark, folder):
    got = {(r.item_id, r.doc_id): r.support for r in plans.QUERIES["claim_support_status"](spark, folder).collect()}
    for q, item in enumerate(ITEMS):
        words = _claim_words(item)
        for d, t in enumerate(DOCS):
            assert got.pop((q, d)) == (round(_hits(words, t) / len(words), 6) if words else 0.0)
    assert not got


def test_word_hits_in_blocks_and_batches(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abc1") for _ in range(rng.randint(2, 5))) for _ in range(60)]
    docs = [(i, "-".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12)))) for i in range(300)]
    items = [(f"q{i}", " ".join(rng.choice(vocabulary) for _ in range(4))) for i in range(40)]
    d, q = spark.createDataFrame(docs, "d long, t string").repartition(3), spark.createDataFrame(items, "q string, t string")
    want = {(k, i): _hits(set(w.split()), t) for k, w in items for i, t in docs}
    every = evidence.word_hits(d, "d", F.col("t"), q, "q", F.split("t", " "), block=7).collect()
    assert len(every) == len(want) and {(r.q, r.d): r.hits for r in every} == want
    best = {}
    for r in evidence.word_hits(d, "d", F.col("t"), q, "q", F.split("t", " "), k=5, block=7).collect():
        best.setdefault(r.q, []).append((-r.hits, r.d))
    for k, _ in items:
        ranked = sorted((-s, i) for (x, i), s in want.items() if x == k and s)
        assert sorted(best.get(k, []))[:5] == ranked[:5]


@pytest.mark.parametrize("k", [5, None])
def test_word_hits_hold_small_tables(k):
    """A full Arrow batch of texts with many runs that meets many queries: what a task holds doesn't grow with either."""
    queries = [[f"w{i % 97:02d}", f"x{i:04d}"] for i in range(1000)]
    run = evidence._hits_in_batches(pa.array(range(1000)), queries, k)
    n = 6000 if k else 1500
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([f"w{i % 97:02d} x{i:04d} " + " ".join(f"r{i}y{j}" for j in range(40 if k else 0)) for i in range(n)])], names=["id", "low"])
    tracemalloc.start()
    got = {}
    for part in run([batch]):
        for q, d, hits in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True) if k else ():
            got.setdefault(q, []).append((-hits, d))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    if k:
        assert {q: sorted(x)[:5] for q, x in got.items()} == {q: [(-2, q), *((-1, d) for d in range(q % 97, n, 97) if d != q)][:5] for q in range(1000)}
    assert peak < 70e6


def test_titles_are_whole_first_lines(spark, tmp_path):
    same = " ".join(f"word{i:02d}" for i in range(20))  # longer than 120 characters
    texts = [f"{same} one\nbody", f"{same} two\nother", f"{same} one\nthird", " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(100))]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: plans.QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted((r.n, r.first_doc) for r in run("normalized_title_clusters")) == [(1, 1), (1, 3), (1, 4), (2, 0)]
    assert sorted(r.doc_id for r in run("round_robin_requests")) == [0, 1, 3, 4]
    sets = [set(t.split("\n")[0].split()) for t in texts]
    pairs = {(r.id_a, r.id_b): r.similarity for r in run("title_jaccard_pairs")}
    jaccard = lambda a, b: round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)
    assert pairs == {(a, b): jaccard(a, b) for b in range(5) for a in range(b) if jaccard(a, b) >= 0.65} and len(pairs) == 3


def test_memory_holds_every_key_of_its_time(spark, tmp_path):
    import datetime as dt

    rows = [(i, dt.datetime(2024, 1, day), u, "view", 1.0) for i, (u, day) in enumerate([(7, 2), (7, 19), (17, 3), (8, 4), (9, 19)])]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    from newsloom.plans import news

    assert {r.memory_key for r in news._memory(spark, str(tmp_path)).collect()} == {f"url:https://example.com/{u}" for u in (7, 17, 8)}
