"""Each operator against a plain version of what it is meant to give."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import ann, decontaminate, langid, license_scan, line_dedup, mixing, quality, simhash_dedup, suffix_dedup, toxicity
from newsloom.llm.common import Scratch, components, may_hold

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def _docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def _prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing"]) for _ in range(n))


def _roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900)]
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"), Scratch(spark, "t")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == _roots(nodes, [e for e in edges if e[0] != e[1]])


def test_bitmap_loses_nothing(spark):
    rows, wanted = spark.range(5000).selectExpr("id * 7919 AS k"), spark.range(0, 5000, 50).selectExpr("id * 7919 AS k")
    held = may_hold(rows, "k", wanted, bits=17)
    assert held.join(wanted, "k").count() == 100 and held.count() < 400


def test_license_scan_finds_variants(spark):
    mit = license_scan.MIT.replace('"', "''").upper()
    texts = ["Copyright (c) 2020 A. Person\n\n" + mit, "intro\nReleased  under the MIT Licence!\nmore", "1) " + license_scan.MIT, license_scan.MIT[:-20], "some\n\nLicensed under the Apache License, v2.0.\n\nend", None, ""]
    got = {r.doc_id: (r.whole_license, r.notices) for r in license_scan.scan(_docs(spark, texts)).collect()}
    assert got[0][0] == "MIT" and got[2][0] == "MIT" and got[3][0] is None
    assert got[1] == (None, "MIT") and got[5] == (None, "") and got[6] == (None, "")
    assert "Apache-2.0" in got[4][1]


@pytest.mark.parametrize("max_list", [2048, 3])
def test_simhash_components(spark, max_list):
    rng = random.Random(2)
    texts = []
    for _ in range(25):
        base = _prose(rng, 60).split()
        for _ in range(8):
            copy = list(base)
            copy[rng.randrange(60)] = "edited"
            texts.append(" ".join(copy))
    texts += ["", None, "  \t", "one two", "ONE TWO", "one two three four five"]
    rows = simhash_dedup.near_duplicates(_docs(spark, texts), max_list=max_list).collect()
    fp = {i: simhash_dedup.fingerprint(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.fp % 2**64 for r in rows} == fp
    edges = [(i, j) for i in fp for j in fp if i < j and bin(fp[i] ^ fp[j]).count("1") <= 4]
    assert {r.doc_id: r.component_id for r in rows} == _roots(fp, edges)


def test_fingerprint_is_as_stated():
    import xxhash

    text = "A b\tc d\x0be c"
    shingles = ["a b c d", "b c d e", "c d e c"]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    assert simhash_dedup.fingerprint(text) == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > 3)


def test_pfair_lag_is_below_one_block():
    for parts in ([1, 1], [7, 2, 1], [5, 5, 3, 2, 1], [97, 2, 1], [1] * 9):
        q, slots = sum(parts), mixing.period(parts)
        served = [0] * len(parts)
        for t, i in enumerate(slots, 1):
            served[i] += 1
            assert all(abs(s * q - t * p) < q for s, p in zip(served, parts, strict=True))
        assert served == parts


def _simulated(blocks, parts):
    """Slot by slot, with phases: (source, block) in order."""
    left, out, done = list(blocks), [], [0] * len(blocks)
    while any(left):
        p = [w if n else 0 for w, n in zip(parts, left, strict=True)]
        q, served, t = sum(p), [0] * len(p), 0
        while all(n > 0 for n, w in zip(left, p, strict=True) if w):
            due = min((-(-(served[i] + 1) * q // w), i) for i, w in enumerate(p) if w and served[i] * q // w <= t)
            i = due[1]
            out.append((i, done[i]))
            served[i], left[i], done[i], t = served[i] + 1, left[i] - 1, done[i] + 1, t + 1
    return out


def test_mixing_equals_simulation(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("aaaaabbbc"), f"t{i}") for i in range(700)] + [(None, None, "x"), (3, "a", "t3")]
    df = spark.createDataFrame(rows, "doc_id long, source string, mix_slot string")
    weights = {"a": 3, "b": 4, "c": 2, None: 1}
    out = mixing.mix(df, weights=weights, block_rows=16).collect()
    assert len(out) == len(rows)
    counts = Counter(r[1] for r in rows)
    names = sorted(counts, key=lambda k: "n" if k is None else f"s{k}")
    want = {(names[i], b): s for s, (i, b) in enumerate(_simulated([-(-counts[n] // 16) for n in names], [weights[n] for n in names]))}
    assert {(r.source, r.mix_block): r.mix_slot for r in out} == want
    for name in names:
        own = sorted(((r.mix_block, r.mix_place, hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()) for r in out if r.source == name))
        assert [h for *_, h in own] == sorted(h for *_, h in own) and [(b, p) for b, p, _ in own] == [divmod(i, 16) for i in range(counts[name])]
    ordered = mixing.order(mixing.mix(df, weights=weights, block_rows=16), 3).collect()
    assert [r.mix_slot for r in ordered] == sorted(r.mix_slot for r in out)


def test_decontamination_paths_agree(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    extra = spark.createDataFrame([(900, "thth, QUITE short!"), (901, ""), (902, None), (903, "?!")], "item_id long, text string")
    more = spark.createDataFrame([(5000, "so thth quite short it is"), (5001, None), (5002, "")], "doc_id long, text string")
    docs, items = docs.select("doc_id", "text").union(more), items.select("item_id", "text").union(extra)
    a = decontaminate.report(docs, items).orderBy("doc_id").collect()
    b = decontaminate.report(docs, items, max_broadcast_windows=10).orderBy("doc_id").collect()
    assert a == b
    by = {r.doc_id: r for r in a}
    assert (by[5000].n_hit, by[5000].n_items, by[5000].items_sha256) == (3, 1, hashlib.sha256(b"900").hexdigest())
    kept = {r.doc_id for r in decontaminate.drop_documents(docs, items).collect()}
    assert kept == {r.doc_id for r in a if not r.contaminated} == {r.doc_id for r in decontaminate.drop_documents(docs, items, max_broadcast_windows=10).collect()}
    clean = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, items).collect()}
    assert clean[5000] == "so    it is" and clean[5001] is None
    assert decontaminate.report(decontaminate.remove_spans(docs, items), items).where("contaminated").count() == 0


def _close(a, b, similarity=0.8):
    """Whether the Levenshtein distance is at most (1 - similarity) of the longer text, row by row of the whole table."""
    import numpy as np

    most = int(max(len(a), len(b)) * (1 - similarity) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    y = np.frombuffer(b.encode("utf-32-le"), dtype=np.uint32)
    place = np.arange(len(y) + 1)
    row = place
    for i, c in enumerate(map(ord, a)):
        new = np.minimum(row + 1, np.concatenate([[i + 1], row[:-1] + (y != c)]))
        row = np.minimum.accumulate(new - place) + place
        if row.min() > most:
            return False
    return row[-1] <= most


def test_line_dedup_against_all_pairs(spark):
    """Groups of lines against those of all pairs by edit similarity alone: none is wider, and nine of ten links are found."""
    import re

    rng = random.Random(6)
    base = [_prose(rng, n) for n in (3, 8, 14, 30, 70) for _ in range(4)]
    docs = []
    for _ in range(40):
        lines = []
        for _ in range(4):
            w = rng.choice(base).split()
            for _ in range(rng.randrange(1 + max(1, len(w) // 20))):
                w[rng.randrange(len(w))] = rng.choice(["x", "gamma gamma", "Alpha!"])
            lines.append(" ".join(w) if rng.random() < 0.8 else " ".join(w).upper() + " ... ")
        docs.append("\n".join([*lines, "", "!!", "the the"]))
    docs += [None, "", "\n\n", "the. the", "word " * 300 + "a", "word " * 300 + "b"]
    rows = [(i, k, " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", x.lower()))) for i, t in enumerate(docs) for k, x in enumerate((t or "").split("\n"))]
    rows = [r for r in rows if r[2]]
    forms = sorted({r[2] for r in rows})
    number = {s: i for i, s in enumerate(forms)}
    near = [(i, j) for i in range(len(forms)) for j in range(i + 1, len(forms)) if _close(forms[i], forms[j])]
    roots = _roots(range(len(forms)), near)
    df = _docs(spark, docs).withColumn("n_chars", F.length("text").cast("long")).withColumn("line_no", F.lit(1))
    gone = {(r.doc_id, r.line_no): (r.keeper_id, r.keeper_line) for r in line_dedup.duplicate_lines(df).collect()}
    form = {(i, k): s for i, k, s in rows}
    kept = {(i, k): gone.get((i, k), (i, k)) for i, k, _ in rows}
    for at, keeper in kept.items():
        assert keeper not in gone and keeper <= at and roots[number[form[at]]] == roots[number[form[keeper]]]
    group = {form[at]: form[keeper] for at, keeper in kept.items()}
    assert all(group[s] == form[kept[i, k]] for i, k, s in rows)  # equal forms are one group
    found = sum(group[forms[i]] == group[forms[j]] for i, j in near)
    assert near and found >= 0.9 * len(near), (found, len(near))
    out = {r.doc_id: r for r in line_dedup.remove(df, length_col="n_chars").collect()}
    lost = defaultdict(set)
    for i, k in gone:
        lost[i].add(k)
    for i, t in enumerate(docs):
        text = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lost[i])
        assert out[i].text == text and out[i].n_chars == (None if t is None else len(text)) and out[i].line_no == 1


def test_line_dedup_links_lines_with_one_changed_word(spark):
    """Every line of 12 to 30 words with one other word is linked, wherever the word stands; the same words in another order are not."""
    rng = random.Random(8)
    pairs = []
    for n in range(100):
        w = [f"{rng.choice(WORDS)}{n}x{i}" for i in range(rng.randrange(12, 31))]
        other = list(w)
        other[rng.randrange(len(w))] = "changed"
        pairs += [" ".join(w), " ".join(other)]
    assert line_dedup.duplicate_lines(_docs(spark, pairs)).count() == 100
    words = [f"{rng.choice(WORDS)}{i}" for i in range(20)]
    orders = [" ".join(rng.sample(words, 20)) for _ in range(30)]
    assert line_dedup.duplicate_lines(_docs(spark, orders)).count() == 0


def _removed(texts, n):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for p in range(len(b) - n + 1):
            w = b[p : p + n]
            if w in seen:
                hit[p : p + n] = b"\1" * n
            seen.add(w)
        out.append((b, hit))
    return out


@pytest.mark.parametrize("length", [20, 100])
def test_suffix_dedup_equals_brute_force(spark, length, monkeypatch):
    rng = random.Random(8)
    blocks = [_prose(rng, n) for n in (5, 20, 40, 90)]
    texts = ["".join(rng.choice([rng.choice(blocks), _prose(rng, 9), "ab" * 70, "é" * 60, "z" * 150]) for _ in range(rng.randint(0, 5))) for _ in range(80)]
    texts += [None, "", "x", "z" * 500, blocks[3]]
    df = _docs(spark, texts).withColumn("ranges", F.lit(0))
    got = {r.doc_id: r for r in suffix_dedup.report(df, length=length).collect()}
    for i, (b, hit) in enumerate(_removed(texts, length)):
        kept = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        runs = sum(h and not (k and hit[k - 1]) for k, h in enumerate(hit))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(hit), runs, hashlib.sha256(kept).hexdigest())


def test_spans_of_long_texts_do_not_depend_on_chunks(monkeypatch):
    rng = np.random.default_rng(1)
    b = rng.integers(97, 100, 3000, dtype=np.uint8)
    whole = suffix_dedup.spans(b, 100)
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 700)
    cut = suffix_dedup.spans(b, 100)
    assert whole["n"].sum() == cut["n"].sum() == 2901
    assert set(whole["start"]) <= set(cut["start"])


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 32))
    x = (centres[rng.integers(0, 30, 1500)] + 0.5 * rng.normal(size=(1500, 32))).astype(np.float32)
    x[7], x[8] = x[100], x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2100, [0.0] * 32), (2200, [float("nan")] * 32), (2300, [None] * 32), (2400, [1.0]), (None, x[0].tolist()), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got = defaultdict(list)
    for r in ann.nearest(df, "id % 100 = 0", block_rows=400).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 100))
    hits = 0
    d = x.astype(np.float64)
    for q, found in got.items():
        dist = np.sqrt(((d - d[q]) ** 2).sum(axis=1))
        dist[q] = np.inf
        want = np.lexsort((np.arange(1500), dist))[:10]
        hits += len({i for i, _ in found} & set(want.tolist()))
        assert all(abs(s - dist[i]) < 1e-12 for i, s in found) and [(s, i) for i, s in found] == sorted((s, i) for i, s in found)
    assert hits >= 0.9 * 150
    assert [i for i, _ in got[100][:2]] == [7, 8]
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [5.0, 5.0])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in ann.nearest(few, "id = 0").orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_multi_index_finds_every_code_in_the_radius():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 2**16, (3000, 4), dtype=np.uint16)
    codes[:50] = codes[0] ^ (1 << rng.integers(0, 16, (50, 4))).astype(np.uint16)
    index = ann.BlockIndex(codes)
    for r in (0, 3, 4, 9, 18, 64):
        want = np.flatnonzero(np.bitwise_count(codes ^ codes[0]).sum(axis=1) <= r)
        assert (index.within(codes[0], r) == want).all()


def test_toxicity_on_held_out_texts():
    rng = random.Random(9)
    bad = ["wretched", "vermin", "fool", "garbage"]
    text = lambda toxic: " ".join(rng.choice(bad) if toxic and rng.random() < 0.08 else rng.choice(WORDS) for _ in range(150))
    y = [int(i % 4 == 0) for i in range(480)]
    texts = [text(v) for v in y]
    m = toxicity.Model().fit(texts[:360], y[:360])
    s = np.array([m.score(t) for t in texts[360:]])
    held = np.array(y[360:])
    assert ((s >= 0.7) == held).mean() > 0.95
    assert 0 <= m.score(None) == m.score("") <= 1
    assert toxicity.Model().fit([], []).score("x") == 0.0


def test_quality_on_held_out_texts():
    rng = random.Random(10)

    def text(good):
        w = [rng.choice(WORDS) for _ in range(rng.randint(20, 400))]
        at = rng.randrange(len(w))
        return " ".join(w if good else w[:at] + [x + "$$$" for x in w[: max(40, len(w) // 2)]] + w[at:])

    y = [int(i % 3 > 0) for i in range(300)]
    texts = [text(v) for v in y]
    m = quality.Model().fit(texts[:220], y[:220])
    assert ((m.scores(texts[220:]) >= 0.5) == np.array(y[220:])).mean() > 0.95
    whole = m.scores(texts)
    assert np.allclose(whole[:7], m.scores(texts[:7])) and 0 <= m.scores([None])[0] == m.scores([""])[0] <= 1


def test_language_spans():
    en, de, el = "the house is on the hill and the water runs down to it", "das haus steht auf dem berg und das wasser fliesst herab", "το σπίτι είναι στον λόφο"
    m = langid.Model().fit([en, de, el] * 3, ["en", "de", "el"] * 3)
    assert [x for x, _ in m.predict([en, de, el, None, "123 !!", ""])] == ["en", "de", "el", "und", "und", "und"]
    mixed = m.spans([f"{en} {de} {el}"])[0]
    assert [s["lang"] for s in mixed] == ["en", "de", "el"] and sum(s["n_words"] for s in mixed) == 13 + 11 + 5


def test_viterbi_equals_brute_force():
    m = langid.Model(switch_penalty=3.0)
    m.langs, rng = ["a", "b", "c"], np.random.default_rng(2)
    m._rows = -rng.random((50, 3)).astype(np.float32) * 6
    m._cache = {f"w{chr(97 + i // 26)}{chr(97 + i % 26)}": i for i in range(50)}
    words = list(m._cache)
    texts = [" ".join(rng.choice(words, n)) for n in (1, 2, 7, 30, 200)]
    m._cache |= {}
    for text, (found, path) in zip(texts, m.paths(texts), strict=True):
        e = [m._rows[m._cache[w]] for w in found]
        score = lambda p, e=e: sum(x[k] for x, k in zip(e, p, strict=True)) - 3.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        best = [0.0] * 3
        for x in e:
            best = [max(best[j] - (3.0 if j != k else 0) for j in range(3)) + x[k] for k in range(3)] if x is not e[0] else list(x)
        assert abs(score(list(path)) - max(best)) < 1e-3 and len(found) == len(text.split())
