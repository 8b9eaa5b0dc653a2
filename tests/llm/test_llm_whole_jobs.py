"""Operators where an earlier version did less than the whole job."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from newsloom.llm import toxicity


def _invented(rng, n):
    return ["".join(rng.choice("bcdfghklmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(n)]


@pytest.mark.parametrize("labels", [20, 300, 1500])
def test_toxicity_is_found_at_any_number_of_labels(labels):
    rng = random.Random(labels)
    plain, bad = _invented(rng, 800), [w + "x" + v for w, v in zip(_invented(rng, 10), _invented(rng, 10), strict=True)]

    def text(toxic):
        w = [rng.choice(plain) for _ in range(60)]
        for _ in range(4 if toxic else 0):
            w[rng.randrange(60)] = rng.choice(bad)
        return " ".join(w)

    y = [1] * labels + [0] * 2 * labels
    m = toxicity.Model().fit([text(v) for v in y], y)
    assert sum(m.score(text(1)) >= 0.5 for _ in range(100)) >= 80
    assert sum(m.score(text(0)) >= 0.5 for _ in range(100)) <= 5


def test_near_duplicate_stage_equals_brute_force_jaccard(spark):
    rng = random.Random(5)
    vocabulary, texts = _invented(rng, 500), []
    for n in (12, 40, 40, 90, 200):
        base = [rng.choice(vocabulary) for _ in range(n)]
        for edits in (0, 0, 1, 1, 1, 2, 2, 3, 4, 6):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(n)] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(20)] + ["", None, "  ", "one two", "ONE  two", "one two three"]

    def cut(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [cut(t) for t in texts]
    root = list(range(len(texts)))
    linked = lambda a, b: a == b or (a and b and len(a & b) >= 0.8 * len(a | b))
    for i in range(len(texts)):
        for j in range(i):
            if linked(sets[i], sets[j]) and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, df, "").collect()}
    assert got == set(root) and len(got) < len(texts)
