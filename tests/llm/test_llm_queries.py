"""The queries of the subpackage: folds, columns, thresholds, their SQL, and public functions on odd tables."""

from __future__ import annotations

import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from newsloom.llm import ann, decontaminate, langid, mixing, quality, queries, sql, suffix_dedup, toxicity
from newsloom.llm.common import Scratch, components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def _docs(duck):
    return duck.execute("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(sql.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    c = duck.execute(sql.ORACLE_SQL[name])
    columns = [x[0] for x in c.description]
    order = sorted(df.columns)
    assert order == sorted(columns)
    want = sorted(tuple(r[columns.index(k)] for k in order) for r in c.fetchall())
    assert sorted(tuple(r[k] for k in order) for r in df.collect()) == want


@pytest.mark.parametrize(("name", "module", "label", "m", "held", "at", "sizes"), [("op2_toxicity", toxicity, "toxic", 3, 1, 0.7, (1500, 3000)), ("op3_quality_classifier", quality, "quality", 5, 0, 0.3, (600, 1800))])
def test_classifier_query_equals_plain_loop(spark, duck, name, module, label, m, held, at, sizes):
    """Learned from the rows of the fold alone, in the sample's order; every document once, scored by the model as it is."""
    df = queries.QUERIES[name](spark, SF)
    assert df.columns == ["doc_id", "held_out", "score", "predicted"]
    got = {r.doc_id: r for r in df.collect()}
    docs = _docs(duck)
    labels = dict(duck.execute(f"SELECT doc_id, {label} FROM labels WHERE {label} IS NOT NULL").fetchall())
    rows = sorted((str(i), t or "", labels[i]) for i, t, _ in docs if i in labels and _crc(i, m) != held)
    assert len(rows) < min(sizes)  # so the bounded sample is all of the fold
    model = module.Model().fit([t for _, t, _ in rows], [y for _, _, y in rows])
    score = (lambda t: model.score(t)) if module is toxicity else (lambda t: float(model.scores([t])[0]))
    assert len(got) == len(docs)
    for i, t, _ in docs:
        r = got[i]
        assert r.held_out == (_crc(i, m) == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= at)
        assert abs(r.score - score(t)) < 1e-9


def test_language_query_equals_plain_loop(spark, duck):
    df = queries.QUERIES["op6_language_id"](spark, SF)
    assert df.columns == ["doc_id", "held_out", "lang_pred", "score"]
    docs = _docs(duck)
    rows = sorted((t or "", k) for i, t, k in docs if k is not None and t is not None and _crc(i, 4) != 2)
    model = langid.Model().fit([t for t, _ in rows], [k for _, k in rows])
    want = dict(zip([i for i, _, _ in docs], model.predict([t for _, t, _ in docs]), strict=True))
    got = {r.doc_id: r for r in df.collect()}
    assert len(got) == len(docs)
    for i, (lang, score) in want.items():
        assert got[i].held_out == (_crc(i, 4) == 2) and got[i].lang_pred == lang and abs(got[i].score - score) < 1e-6
    known = {i: k for i, _, k in docs if k is not None}
    assert sum(want[i][0] == k for i, k in known.items()) > 0.95 * len(known)


def test_number_signs_are_no_letters(spark):
    docs = spark.createDataFrame([(0, "the cat", "en"), (1, "²", None), (2, "½ ½", None), (3, "Ⅷ", None), (4, "㊀", None), (5, "x²y", None), (6, None, None)], "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True))
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert [got[i] for i in range(7)] == ["en", "und", "und", "und", "und", "en", "und"]
    spans = {r.doc_id: r.spans for r in langid.label_spans(docs, model).collect()}
    assert spans[1] == spans[6] == [] and [(s.first_word, s.n_words, s.lang) for s in spans[0]] == [(0, 2, "en")]
    assert langid.label_spans(docs.limit(0), model).collect() == []


def test_trained_dictionaries_at_any_size():
    for n in (2, 20):
        texts = ["you pathetic fool of a clown", "a quiet morning by the sea"] * 3 * n
        model = toxicity.Model().fit(texts, [1, 0] * 3 * n)
        assert all(d[:4] == b"\x37\xa4\x30\xec" for d in (model.toxic, model.ordinary))
    assert toxicity.Model().fit(["a", "b"], [0, 0]).score("x") == 0.0


def test_suffix_remove(spark):
    """Repeated rows are one document and do not cut each other; columns stay; a null id keeps its text."""
    a, b = "x1y2z3 " * 10, "".join(chr(97 + i * 7 % 26) + str(i) for i in range(80))
    rows = [(1, b, "p"), (1, b, "q"), (2, "head " + b + " tail", "r"), (3, None, "s"), (None, b, "t"), (4, "", "u"), (5, a, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = {r.kind: r.text for r in suffix_dedup.remove(df).collect()}
    assert got["p"] == got["q"] == got["t"] == b and got["s"] is None and got["u"] == "" and got["v"] == a
    assert got["r"] == "head  tail"
    assert suffix_dedup.remove(df.limit(0)).collect() == [] and suffix_dedup.remove(df).columns == df.columns


def test_remove_spans_on_both_paths(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None), (None, "zz"), (3, "!!")], "item_id long, text string")
    texts = ["Say: One two, three four five six seven eight nine TEN eleven! and more", "one two three", None, "", "--", "Say: One two, three four five six seven eight nine TEN eleven! and more"]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, item string")
    near, far = ({r.doc_id: r.text for r in decontaminate.remove_spans(docs, items, max_broadcast_windows=n).collect()} for n in (1000, 0))
    assert near == far and near[0] == near[5] == "Say:  ,         ! and more" and [near[i] for i in (1, 2, 3, 4)] == ["one two three", None, "", "--"]
    assert decontaminate.remove_spans(docs.limit(0), items, max_broadcast_windows=0).collect() == []


def test_vectors_of_several_lengths(spark):
    rows = [(i, [float(i), 1.0]) for i in range(5)] + [(10 + i, [1.0, float(i), 2.0]) for i in range(3)] + [(20, [1.0])] + [(0, [0.5, 0.5])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 10 = 0").collect()
    by = {q: [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (0, 10, 20)}
    assert by == {0: [(1, 1), (2, 2), (3, 3), (4, 4)], 10: [(1, 11), (2, 12)], 20: []}


def test_order_of_an_empty_mixture(spark):
    assert mixing.order(mixing.mix(spark.createDataFrame([], "doc_id long, source string"))).collect() == []


def test_components_that_do_not_end_raise(spark):
    path = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    with pytest.raises(RuntimeError):
        components(path, Scratch(spark, "t"), max_rounds=1)
