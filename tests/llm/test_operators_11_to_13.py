"""Token alignment, importance resampling and personal data against plain loops; odd and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from newsloom.llm import pii, queries, resample, token_align

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, id string, h string, key string, pieces string, rank string, n_words string, spans string, owned string"
LONG = "Of the orea nt lyeaing thre, said 42 people. " * 3000


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, *["x"] * 8) for i, t in texts], SCHEMA)


ODD = [(1, "one two three, four five six"), (1, "one two three, four five six"), (2, None), (3, ""), (4, LONG), (5, LONG), (None, "nobody's text"), (7, " \n\t\n"), (8, "naïve ퟿ 𝒳 Ελληνικά 中文 ▁ x"), (9, "naïve ퟿ 𝒳 Ελληνικά 中文\n\nend"), (10, "x" * 30_000)]


def _rows(spark, name):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()] if name == "documents" else [r.text for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


# Token alignment


def _aligned(texts):
    """Whole texts tokenised, ends compared byte by byte."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=B)
    t = token_align.tokenizers(A, B)
    linked, made = [], []
    for text in texts:
        raw, xs, ys = (" " + (text or "")).encode(), [], []
        if text:
            xs, ys = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            if b"".join(t.a_bytes[i] for i in xs) != raw or b"".join(t.b_bytes[i] for i in ys) != raw:
                xs, ys = [], []
        ends_of = lambda ids, of: list(zip(ids, [sum(w) for w in _running([len(of[i]) for i in ids])], strict=True))
        ea, eb = ends_of(xs, t.a_bytes), ends_of(ys, t.b_bytes)
        both = {e for _, e in ea} & {e for _, e in eb}
        groups, ga, gb = [], defaultdict(list), defaultdict(list)
        for pool, found in ((ga, ea), (gb, eb)):
            g = 0
            for i, e in found:
                pool[g].append(str(i))
                g += e in both
        groups = [f"{','.join(ga[g])}|{','.join(gb[g])}" for g in range(len(both))]
        at_a, at_b = {e: i for i, e in ea}, {e: i for i, e in eb}
        linked.append([(at_a[e], at_b[e]) for e in both])
        made.append((len(xs), len(ys), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest() if xs else ""))
    counts = Counter(p for x in linked for p in x)
    best = defaultdict(int)
    for (_, b_id), n in counts.items():
        best[b_id] = max(best[b_id], n)
    return [(*m[:3], len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), m[3]) for m, x in zip(made, linked, strict=True)]


def _running(lens):
    total = 0
    for n in lens:
        total += n
        yield (total,)


_COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _check(df, texts):
    want = Counter((i, *x) for (i, _), x in zip(texts, _aligned([t for _, t in texts]), strict=True))
    assert Counter((r.doc_id, *(r[c] for c in _COLUMNS)) for r in df.collect()) == want


def test_alignment_query_equals_plain_loop(spark):
    _check(queries.QUERIES["op11_token_alignment"](spark, SF), _rows(spark, "documents"))


@pytest.mark.parametrize("frequent", [0, 5, 1000])
def test_alignment_of_odd_rows(spark, frequent):
    """With no, few and all pieces broadcast, the rest joined."""
    rng = random.Random(5)
    made = ["".join(rng.choice(["the ", " ", "\n", "don't", "'ll", ",", "...", "é", "ß", " \n", "\r\n", "1", "23", "中", "😀", "<s>", "<|endoftext|>", "á", " ", "x²", "«", "»", "_", "'", " ", "Ω", "ї", "\x00", "²."]) for _ in range(60)) for _ in range(80)]
    texts = ODD + [(100 + i, t) for i, t in enumerate(made)]
    df = token_align.align(_docs(spark, texts), A, B, frequent=frequent)
    assert df.columns == ["doc_id", *_COLUMNS]
    _check(df, texts)


def test_alignment_of_whole_texts(spark, monkeypatch):
    """The way of vocabularies without sure cuts, and texts that tokenizers don't give back."""
    t = token_align.tokenizers(A, B)
    monkeypatch.setattr(t, "sure", False)
    texts = [x for x in ODD if x[0] != 10 and (x[1] or "x")[:1] != " "]
    df = token_align.align(_docs(spark, [(i, x) for i, x in texts if x != LONG]), A, B, frequent=2)
    _check(df, [(i, x) for i, x in texts if x != LONG])


def test_alignment_without_rows(spark):
    assert token_align.align(_docs(spark, []), A, B).collect() == []


def test_linked_pairs_are_bounded():
    t = token_align.tokenizers(A, B)
    assert t.sure and token_align.pair_bound(t) < 1_000_000


# Importance resampling


def _weighed(docs, items, percent=5):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def features(text):
        ws = word.findall((text or "").translate(lower))
        return len(ws), [zlib.crc32(" ".join(ws[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(ws) - n + 1)]

    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(x for _, _, f in found for x in f), Counter(x for text in items for x in features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    rows = []
    for i, n, f in found:
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = Counter((r[0], *r[2:], k) for k, r in enumerate(able[: percent * len(able) // 100], 1))
    rest = Counter((r[0], *r[2:], None) for r in able[percent * len(able) // 100 :]) + Counter((r[0], *r[2:], None) for r in rows if r[1] < 20)
    return drawn + rest


def _got(df):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


def test_resampling_query_equals_plain_loop(spark):
    df = queries.QUERIES["op12_importance_resampling"](spark, SF)
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in df.dtypes} == {"bigint"}
    assert _got(df) == _weighed(_rows(spark, "documents"), _rows(spark, "benchmark"))


def test_resampling_of_odd_rows(spark):
    items = spark.createDataFrame([("said people the x",), (None,), ("",)], "text string")
    texts = [*ODD, *((20 + i, f"word{i} of the people that said {i % 3} " * 5) for i in range(60))]
    got = _got(resample.resample(_docs(spark, texts), items, percent=30))
    assert got == _weighed(texts, ["said people the x", None, ""], 30)
    assert resample.resample(_docs(spark, []), items).collect() == []
    assert _got(resample.resample(_docs(spark, texts), items.limit(0), percent=30)) == _weighed(texts, [], 30)


@pytest.mark.parametrize("own", [1, 2, 7, 100])
def test_chunks_count_each_run_once(spark, own):
    texts = [(1, LONG[:3000]), (2, LONG[:3000]), (2, LONG[:3000]), (3, "a b"), (4, "A b c d " * 30)]
    docs = _docs(spark, texts)
    whole = sorted(map(tuple, resample.bucket_counts(docs).collect()))
    assert sorted(map(tuple, resample.bucket_counts(docs, long=10, own=own).collect())) == whole
    gain = resample.gains(resample.bucket_counts(docs), resample.bucket_counts(docs.where("doc_id = 4")))
    rows = lambda **k: sorted(map(tuple, resample.weigh(docs, gain, **k).collect()))
    assert rows(long=10, own=own) == rows() and len(rows()) == 5


# Personal data

_BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and _luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def _luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _plain(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in _BASE.items() for m in re.finditer(p, text or "") if ok(m[0])]


def test_pii_query_equals_plain_patterns(spark):
    docs = dict(_rows(spark, "documents"))
    rows = queries.QUERIES["op13_pii"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        base = _plain(docs[r.doc_id])
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        assert set(said.split(",")) <= set(r.spans.split(",")) and r.n_added == len([x for x in r.spans.split(",") if x]) - len(base)


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "@", ".", "-", "_", "%", " ", "+", "1", "22", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1111", "00", "(", ")", "1.2.3.4", "x@y.z", "+1 (988) 555-2485", "é", "٣", "12345678901234567"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert [(k, *s) for k, v in pii.base_spans(text).items() for s in v] == _plain(text), text


DISGUISED = [
    ("email", "write to {} now", "john [at] example [dot] com"),
    ("email", "write to {}, please", "bob.smith at mail8 dot example dot com"),
    ("email", "or {}.", "bosbt.42 at mail8.example.com"),
    ("email", "a {} b", "јоhn@example.com"),
    ("email", "a {} b", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("email", "a {} b", "user&#64;host&#46;com"),
    ("email", "a {} b", "jo​hn@exa​mple.com"),
    ("email", "a {} b", "john @ example . com"),
    ("ip", "host {} is down", "192[.]168[.]1[.]1"),
    ("ip", "host {} is down", "one nine two dot one six eight dot zero dot one"),
    ("card", "card {} ok", "４１１１ １１１１ １１１１ １１１１"),
    ("card", "card {} ok", "four one one one one one one one one one one one one one one one"),
    ("card", "card {} ok", "4111‑1111‑1111‑1111"),
    ("phone", "call {} today", "plus one five five five oh one two three four"),
    ("phone", "call {} today", "+1 (988) 555‑2485"),
]


@pytest.mark.parametrize(("kind", "around", "told"), DISGUISED)
def test_disguises_are_found_at_their_place(kind, around, told):
    text = "中é " + around.format(told)
    base, added = pii.spans_of(text)
    assert [text[a:b] for a, b in added[kind]] == [told]
    assert all(not v for k, v in added.items() if k != kind) and [(k, *s) for k, v in base.items() for s in v] == _plain(text)


CLEAN = ["Look at the dot product at home. Point at it.", "meet us at example.com", "heesed. He. Ndhe at ntinhe. At", "one two, three", "from 1990–2012 and 5 five 6", "tél. été à noël ½ ² №", "He ran at noon (at) last.", "3.14 and 1,000,000 at 10.5 percent", "Москва в 2010–2012 годах", "a @ b"]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_are_left_alone(text):
    assert all(not v for found in pii.spans_of(text) for v in found.values())


def test_pii_of_odd_rows(spark):
    texts = [*ODD, (30, "a@b.co, 1.2.3.4 +1 (988) 555-2485"), (31, "j" * 200_000), (32, "1" * 100_000 + "@" * 1000), (33, "+1" + " " * 100_000)]
    found = pii.find(_docs(spark, texts))
    rows = {r.doc_id: [x.kind for x in r.spans] for r in found.collect() if r.doc_id != 1}
    assert rows[30] == ["email", "ip", "phone"] and not any(v for k, v in rows.items() if k != 30) and found.count() == len(texts)
    assert pii.find(_docs(spark, [])).collect() == [] == pii.redact(_docs(spark, [])).collect()
    clean = pii.redact(_docs(spark, texts))
    assert clean.columns == SCHEMA.replace(" string", "").replace(" long", "").split(", ")
    said = {r.doc_id: r.text for r in clean.collect()}
    assert said[30] == "<EMAIL>, <IP> <PHONE>" and said[2] is None and said[4] == LONG
