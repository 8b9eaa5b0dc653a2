"""Nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsloom.llm import ann, decontaminate, langid, license_scan, line_dedup, mixing, quality, simhash_dedup, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, score string, h string, fp string, rank string, key string"
LONG = "Of the orea nt lyeaing thre. " * 12_000


def _row(i, text, lang="en", source="a"):
    return (i, text, lang, source, None, "x", "x", "x", "x", "x", "x", "x")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [_row(1, "one two three four five six"), _row(1, "one two three four five six"), _row(2, None), _row(3, ""), _row(4, LONG), _row(5, LONG), _row(None, "nobody's text"), _row(7, " \n\t\n", None, None), _row(8, "naïve ퟿ 𝒳 Ελληνικά 中文")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "one two three four five six", "z"), (None, "x", "z"), (2, None, "z")], "item_id long, text string, doc_id string")


def _runs(spark, docs, items):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return {
        "license": lambda: license_scan.scan(docs), "toxicity": lambda: toxicity.score(docs, toxicity.train(docs, labels, F.lit(True))), "quality": lambda: quality.score(docs, quality.train(docs, labels, F.lit(True))),
        "simhash": lambda: simhash_dedup.near_duplicates(docs), "mix": lambda: mixing.mix(docs, block_rows=2), "langid": lambda: langid.identify(docs, langid.train(docs, F.lit(True))), "decontaminate": lambda: decontaminate.report(docs, items),
        "line": lambda: line_dedup.report(docs), "suffix": lambda: suffix_dedup.report(docs),
    }


@pytest.mark.parametrize("name", ["license", "toxicity", "quality", "simhash", "mix", "langid", "decontaminate", "line", "suffix"])
def test_odd_and_empty_tables(spark, odd, empty, items, name):
    out = _runs(spark, odd, items)[name]().collect()
    assert len(out) == (8 if name == "suffix" else 9)  # rows repeated under one id are one document there
    assert _runs(spark, empty, items)[name]().collect() == []


def test_results_of_odd_rows(spark, odd, items):
    run = _runs(spark, odd, items)
    fp = {r.doc_id: r for r in run["simhash"]().collect()}
    assert fp[2].fp == fp[3].fp == fp[7].fp == 0 and fp[2].component_id == fp[7].component_id == 2 and fp[5].component_id == 4
    hit = {r.doc_id: r.contaminated for r in run["decontaminate"]().collect()}
    assert hit[1] and not any(hit[k] for k in (2, 3, 4, None))
    lang = {r.doc_id: r.lang_pred for r in run["langid"]().collect()}
    assert lang[2] == lang[3] == lang[7] == "und" and lang[4] == "en"
    cut = {r.doc_id: r for r in run["suffix"]().collect()}
    assert cut[5].n_removed == cut[5].n_bytes == len(LONG) and cut[2].n_bytes == 0 and cut[None].n_removed == 0
    gone = {r.doc_id: r.n_removed for r in run["line"]().collect()}
    assert gone[5] == 1 and gone[4] == 0 and gone[2] == gone[3] == gone[7] == 0
    assert all(0 <= r.score <= 1 for k in ("toxicity", "quality") for r in run[k]().collect())


def test_filters_keep_columns(spark, odd, empty, items):
    model = quality.Model().fit([], [])
    for df in (odd, empty):
        assert simhash_dedup.keep_one(df).columns == line_dedup.remove(df).columns == decontaminate.drop_documents(df, items).columns == quality.keep_good(df, model).columns == df.columns
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in simhash_dedup.keep_one(odd).select("doc_id").collect())
    assert kept == [(False, 1), (False, 1), (False, 2), (False, 4), (False, 8), (True, 0)]
    assert decontaminate.drop_documents(odd, items).count() == 7
    assert decontaminate.report(odd, items.limit(0)).where("contaminated").count() == 0


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, rank int")
    assert ann.nearest(none, "id % 100 = 0").collect() == []
    assert ann.nearest(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>"), "id = 0").collect() == []


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, tmp_path, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(0).union(spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c", "en", "s", 5)], docs.schema))
    assert f(spark, docs.limit(0), sf).collect() == []
    out = f(spark, odd, sf)
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() <= 4


def test_pipeline_stage_by_stage(spark):
    """Each stage's rows against its operator's decisions, and the whole against the stages in order."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    good = stages["quality_classifier"](spark, docs, sf).cache()
    from newsloom.llm.common import crc_mod

    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), crc_mod("doc_id", 5) != 0)
    assert ids(good) == ids(quality.score(docs, model).where("predicted = 1"))
    lines = stages["line_dedup"](spark, good, sf).cache()
    assert ids(lines) == ids(good) and lines.where("n_chars <> length(text)").count() == good.where("n_chars <> length(text)").count()
    near = stages["simhash_near_dedup"](spark, lines, sf).cache()
    assert ids(near) == ids(simhash_dedup.similar_documents(lines).where("doc_id = component_id"))
    clean = stages["benchmark_decontamination"](spark, near, sf).cache()
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert ids(clean) == ids(decontaminate.report(near, items).where("NOT contaminated"))
    mixed = stages["source_mixing"](spark, clean, sf)
    assert ids(mixed) == ids(clean)
    whole = corpus_pipeline.run(spark, sf)
    pick = lambda df: sorted((r.doc_id, r.text, r.mix_slot, r.mix_place) for r in df.collect())
    assert pick(whole) == pick(mixed)
