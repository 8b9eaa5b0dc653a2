"""Near copies of one template: every line or document shares its blocks or positions with all the others."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from newsloom.llm import line_dedup, simhash_dedup


def _near_pairs(pairs, total, template, change, seed):
    """Texts 2i and 2i + 1 have a template and words of their own, which differ by ``change``."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    shared, out = [word() for _ in range(template)], []
    for _ in range(pairs):
        own = [word() for _ in range(total - template)]
        out += [" ".join(shared + own), " ".join(shared + change(rng, list(own)))]
    return out


def _letters(n):
    def change(rng, own):
        for i in rng.sample(range(len(own)), n):
            own[i] = own[i][:2] + ("q" if own[i][2] != "q" else "x") + own[i][3:]
        return own

    return change


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize(("pairs", "total", "template", "letters"), [(60, 40, 16, 8), (300, 20, 9, 3)])
def test_lines_of_one_template(spark, pairs, total, template, letters):
    texts = _near_pairs(pairs, total, template, _letters(letters), 1)
    gone = {(r.doc_id, r.keeper_id) for r in line_dedup.duplicate_lines(_docs(spark, texts)).collect()}
    assert gone == {(2 * i + 1, 2 * i) for i in range(pairs)}


@pytest.mark.parametrize("template", [120, 160, 174])
def test_documents_of_one_template(spark, template):
    """Components equal those of all pairs by Jaccard index, also where links between pairs come and go with chance."""
    texts = _near_pairs(60, 200, template, _letters(1), template)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[j])
        if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    got = {r.doc_id: r.component_id for r in simhash_dedup.similar_documents(_docs(spark, texts)).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_documents_of_shared_passages(spark):
    """Each passage has its place and stands there in a third of the documents, so no shingle of a near copy is rare: components equal those of all pairs."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    passages, chosen = [" ".join(word() for _ in range(60)) for _ in range(30)], []
    for _ in range(200):
        one = [3 * at + rng.randrange(3) for at in range(10)]
        other, at = list(one), rng.randrange(10)
        other[at] = 3 * at + (one[at] + 1) % 3
        chosen += [one, other]
    texts = [" ".join(passages[i] for i in c) for c in chosen]
    got = {r.doc_id: r.component_id for r in simhash_dedup.similar_documents(_docs(spark, texts)).collect()}
    assert got == _components_of_all_pairs(texts)


def test_lines_of_shared_passages(spark):
    """Each passage has its place and stands there in a third of the lines, so no block and no word of a near copy is rare."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    passages, texts = [" ".join(word() for _ in range(8)) for _ in range(30)], []
    for _ in range(200):
        one = [3 * at + rng.randrange(3) for at in range(10)]
        other, at = list(one), rng.randrange(10)
        other[at] = 3 * at + (one[at] + 1) % 3
        texts += [" ".join(passages[i] for i in c) for c in (one, other)]
    first = {r.doc_id: r.keeper_id for r in line_dedup.duplicate_lines(_docs(spark, texts)).collect()}
    assert [first.get(2 * i, 2 * i) for i in range(200)] == [first.get(2 * i + 1, 2 * i + 1) for i in range(200)]


def test_lists_in_blocks(spark):
    """All sets of other groups are met once, in blocks as in one, and those of one group not at all."""
    rows = [(k, f"s{i}", "big" if i < 40 else f"l{i % 3}", 10) for k in (1, 2) for i in range(45 + k)]
    want = sorted((p, q) for n in (46, 47) for p, q in combinations([f"s{i}" for i in range(n)], 2) if (la := dict((r[1], r[2]) for r in rows))[p] != la[q])
    for block in (512, 7):
        held = spark.createDataFrame(rows, "key long, sid string, label string, n long")
        got = simhash_dedup._all_pairs(held, F.col("x") != F.col("y"), block).collect()
        assert sorted(tuple(sorted((r.p, r.q), key=lambda s: int(s[1:]))) for r in got) == sorted(want)


def _components_of_all_pairs(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[j])
        if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in range(len(texts))}


def test_lines_around_one_passage(spark):
    """Lines that share a passage and else differ are compared in blocks of any size, and only the linked ones leave the join."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    passage, texts = [word() for _ in range(24)], []
    for _ in range(40):
        own = [word() for _ in range(24)]
        texts += [" ".join(own + passage), " ".join(["other", *own[1:], *passage])]
    rows = line_dedup.lines_of(_docs(spark, texts).withColumnRenamed("doc_id", "id")).select("id", "h", "len", "norm", "blocks", "k").toPandas()
    lines, of = spark.createDataFrame(rows), dict(zip(rows["h"], rows["id"], strict=True))
    held = lines.select(F.explode("blocks").alias("b"), "h", "len", F.col("h").alias("label"))
    for block in (512, 7):
        found = line_dedup._all_links(held, lines.select("h", "norm", "blocks", "k"), 0.8, block).collect()
        assert sorted(tuple(sorted((of[r.x], of[r.y]))) for r in found) == [(2 * i, 2 * i + 1) for i in range(40)]
