"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A window of text that
reads like the toxic side compresses shorter with the toxic dictionary. The toxic side's training
text is the words that hold fragments over-represented in toxic documents (a likelihood-ratio test
on document counts with a bounded share of false discoveries, and a least ratio of the shares, so
that neither depends on the number of labels), as what both sides share tells nothing. A document's
features are statistics of
its windows' length differences; a logistic calibration, fitted on labelled documents that the
dictionaries have not seen, maps them to a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import send

_WORD = re.compile(r"[^\W\d_]+")
_SIZES = (4, 5, 6, 8, 10)
# Ends both dictionaries and starts every window. zstandard stores a block as it is unless it saves a
# few bytes; the anchor's match saves them, so a short window's own matches show in its length.
# The tail is there as the last eight bytes of a block are never matched.
_ANCHOR = bytes(range(1, 33))
_TAIL = bytes(range(0xF0, 0xFA))


def _fragments(words: set[str]) -> set[str]:
    out = set()
    for w in words:
        w = f" {w} "
        for k in _SIZES:
            out.update(w[i : i + k] for i in range(len(w) - k + 1))
    return out


class Model:
    """Dictionaries and calibration; ``score`` maps texts to probabilities."""

    def __init__(self, window_words: int = 1, dictionary_bytes: int = 8192, level: int = 9, false_discovery: float = 0.01, least_ratio: float = 5.0):
        self.n, self.size, self.level, self.false_discovery, self.least_ratio = window_words, dictionary_bytes, level, false_discovery, least_ratio
        self.toxic = self.ordinary = b""
        self.weights: np.ndarray | None = None
        self.rate = 0.0
        self._cache: dict[tuple, int] = {}
        self._pair = None

    def __getstate__(self):
        return {**self.__dict__, "_cache": {}, "_pair": None}

    def windows(self, text: str | None) -> list[tuple]:
        w = _WORD.findall((text or "").lower())
        return w if self.n == 1 else [tuple(w[i : i + self.n]) for i in range(0, len(w), self.n)]

    def _compressors(self):
        import zstandard as zs

        if self._pair is None:
            made = []
            for raw in (self.toxic, self.ordinary):
                # as raw content: trained entropy tables would judge the letters' frequencies, not the matches
                d = zs.ZstdCompressionDict(raw + _ANCHOR, dict_type=zs.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                made.append(zs.ZstdCompressor(level=self.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
            self._pair = made
        return self._pair

    def gains(self, ws: list[tuple]) -> np.ndarray:
        """Bytes by which each window compresses shorter with the toxic dictionary."""
        cache = self._cache
        new = {w for w in ws if w not in cache}
        if new:
            if len(cache) > 2_000_000:
                cache.clear()
                new = set(ws)
            toxic, ordinary = self._compressors()
            for w in new:
                raw = _ANCHOR + f" {w if self.n == 1 else ' '.join(w)} ".encode("utf-8", "surrogatepass") + _TAIL
                cache[w] = len(ordinary.compress(raw)) - len(toxic.compress(raw))
        return np.fromiter((cache[w] for w in ws), dtype=np.int64, count=len(ws))

    def features(self, text: str | None) -> list[float]:
        ws = self.windows(text)
        g = self.gains(ws)
        if not len(g):
            return [0.0] * 9
        top = np.sort(g[g >= 1])[::-1] if (g >= 1).any() else np.zeros(1, dtype=np.int64)
        # windows that the toxic dictionary spells out nearly whole
        whole = sum(g[i] / (2 + len(ws[i] if self.n == 1 else " ".join(ws[i]))) >= 0.45 for i in np.flatnonzero(g >= 3))
        strong = (g >= 4).sum()
        return [top[0] / 8, top[:3].mean() / 8, math.log1p(whole), math.log1p(strong), math.log1p((g >= 2).sum()), 10 * strong / len(g), 10 * whole / len(g), (g >= 1).mean(), g.mean() / 4]

    def fit(self, texts: list[str | None], toxic: list[int], seed: int = 7) -> Model:
        y = np.array(toxic, dtype=float)
        self.rate = float(y.mean()) if len(y) else 0.0
        part = np.random.default_rng(seed).permutation(len(y)) % 3
        learn = [(set(_WORD.findall((t or "").lower())), t, v) for t, v, p in zip(texts, toxic, part, strict=True) if p != 0]
        pos, neg = [x for x in learn if x[2]], [x for x in learn if not x[2]]
        held = part == 0
        if not pos or not neg or len(set(y[held])) < 2:
            return self
        have = Counter(f for w, _, _ in pos for f in _fragments(w))
        have = {f: c for f, c in have.items() if c >= 2}  # what one document holds says nothing of others
        other = Counter(f for w, _, _ in neg for f in _fragments(w) if f in have)
        marked = self._marked(have, len(pos), other, len(neg))
        told = Counter(w for ws, _, _ in pos for w in ws if marked & _fragments({w}))
        words = [f" {w} ".encode() for w, c in told.items() for _ in range(c)]
        rng = np.random.default_rng(seed)
        words = [words[i] for i in rng.permutation(len(words))]

        def pieces(of: list[tuple]) -> list[bytes]:
            found = [" ".join(x).encode() for _, t, _ in of for x in _pieces(_WORD.findall((t or "").lower()), 8)]
            return [found[i] for i in rng.permutation(len(found))]

        # without a fragment that tells, the toxic documents' own windows
        self.toxic = self._train([b"".join(words[i : i + 4]) for i in range(0, len(words), 4)] or pieces(pos))
        self.ordinary = self._train(pieces(neg))
        x = np.array([self.features(t) for t, h in zip(texts, held, strict=True) if h])
        self.weights = _logistic(x, y[held])
        return self

    def _marked(self, have: dict[str, int], n: int, other: dict[str, int], m: int) -> set[str]:
        """Fragments in so much larger a share of toxic documents, by Benjamini and Hochberg's procedure over all of ``have``."""
        p = {f: math.erfc(math.sqrt(_likelihood_ratio(c, n, other[f], m) / 2)) for f, c in have.items()}
        last = max((v for i, v in enumerate(sorted(p.values()), 1) if v <= self.false_discovery * i / len(p)), default=-1.0)
        return {f for f, c in have.items() if p[f] <= last and c / n >= self.least_ratio * (other[f] + 0.5) / (m + 1)}

    def _train(self, samples: list[bytes]) -> bytes:
        """A trained dictionary. Few samples are repeated, as the trainer wants a multiple of the dictionary's size."""
        import zstandard as zs

        total = sum(map(len, samples))
        again = max(1, -(-16 * self.size // max(total, 1)))
        return zs.train_dictionary(self.size, samples * again).as_bytes() if total else b" "

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.rate
        z = float(np.dot([1.0, *self.features(text)], self.weights))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _pieces(words: list[str], n: int) -> list[list[str]]:
    return [words[i : i + n] for i in range(0, len(words), n)]


def _likelihood_ratio(a: int, n: int, b: int, m: int) -> float:
    """G statistic of a of n against b of m; 0 unless the first share is larger."""
    if a * m <= b * n:
        return 0.0
    p = (a + b) / (n + m)
    part = lambda k, t: (k * math.log(k / t / p) if k else 0.0) + ((t - k) * math.log((t - k) / t / (1 - p)) if t - k else 0.0)
    return 2 * (part(a, n) + part(b, m))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 50) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = l2 * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: Column, per_class: dict[int, int], id_col: str = "doc_id", text_col: str = "text") -> list[tuple]:
    """(text, label) of at most ``per_class`` rows of each label, those first by hash of their id.

    ``fold`` is true for the rows that may be learned from. The ids are drawn from the labels first, so
    no more texts than the bound leave the documents. Repeated label rows of an id count once, with
    the largest label; a null label or id is not used.
    """
    once = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & fold).groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    drawn = [once.where(F.col("y") == y).orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(n) for y, n in per_class.items()]
    ids = drawn[0]
    for more in drawn[1:]:
        ids = ids.unionByName(more)
    rows = docs.select(id_col, text_col).join(F.broadcast(ids), id_col).collect()  # bounded by per_class
    rows.sort(key=lambda r: (str(r[0]), r[1] or "", r[2]))
    return [(r[1], r[2]) for r in rows]


def train(docs: DataFrame, labels: DataFrame, fold: Column, max_toxic: int = 1500, max_ordinary: int = 3000, **options) -> Model:
    """A model of at most ``max_toxic`` toxic and ``max_ordinary`` ordinary labelled documents, whole texts."""
    rows = labelled_sample(docs, labels, "toxic", fold, {1: max_toxic, 0: max_ordinary})
    return Model(**options).fit([t for t, _ in rows], [y for _, y in rows])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, score, predicted) for every row: the score of the whole text, and 1 from ``threshold`` on.

    Null and empty texts get the score of a text without windows. Without labelled rows of both kinds,
    among those that the dictionaries learn from and those that calibrate, every score is the share of
    toxic labels (0 if there are none). Repeated rows each give a row.
    """
    get = send(docs.sparkSession, model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = get()
        for b in batches:
            s = np.array([m.score(x.as_py()) for x in b.column(1)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)
