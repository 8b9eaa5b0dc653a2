"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded (character classes, repetition, word
statistics) and passed through a hidden layer; a gated attention (tanh times sigmoid) learned from
document labels alone weighs the passages, and the weighted passage representation is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import send
from newsloom.llm.toxicity import labelled_sample

PASSAGE_WORDS = 64
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b",", b".;:", b"!?", b"|", b"*", b"&", b"$", b"%", b"#", b"\"'()-", b"<>/=@_", bytes(range(0x80, 0x100))]


def _class_table() -> np.ndarray:
    t = np.zeros((256, len(_CLASSES)))
    for i, c in enumerate(_CLASSES):
        t[list(c), i] = 1
    return t


_TABLE = _class_table()
N_FEATURES = len(_CLASSES) + 9


def passages(text: str | None) -> list[list[bytes]]:
    """The passages of a text: runs of 64 words, line ends kept as words. A text without words is one empty passage."""
    w = (text or "").encode("utf-8", "surrogatepass").replace(b"\n", b" \n ").split(b" ")
    w = [x for x in w if x]
    return [w[i : i + PASSAGE_WORDS] for i in range(0, len(w), PASSAGE_WORDS)] or [[]]


def encode(text: str | None) -> np.ndarray:
    """A feature row for each passage of the whole text."""
    bags = passages(text)
    whole = max(1, sum(map(len, bags)))
    rows = np.empty((len(bags), N_FEATURES))
    seen: set[bytes] = set()
    for i, w in enumerate(bags):
        s = b" ".join(w)
        n, m = max(1, len(s)), max(1, len(w))
        rows[i, : len(_CLASSES)] = np.bincount(np.frombuffer(s, dtype=np.uint8), minlength=256) @ _TABLE / n * 4
        kinds = set(w)
        upper = sum(x.isupper() for x in w)
        rows[i, len(_CLASSES) :] = (
            n / m / 6, len(kinds) / m, sum(a == b for a, b in zip(w, w[1:], strict=False)) / m, upper / m, max(map(len, w), default=0) / 20,
            len(kinds & seen) / max(1, len(kinds)), min(m, 64) / 64, np.log(whole) / 6, float(not w),
        )
        seen |= kinds
    return rows


class Model:
    """Encoder, gated attention and classifier; one forward pass scores many bags."""

    def __init__(self, hidden: int = 32, gate: int = 16, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"W": draw(N_FEATURES, hidden), "b": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "a": draw(gate), "c": draw(hidden), "d": np.zeros(1)}
        self.mean, self.scale, self.rate = np.zeros(N_FEATURES), np.ones(N_FEATURES), None

    def _forward(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict:
        p = self.p
        h = np.maximum(x @ p["W"] + p["b"], 0)
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        w = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(w[:, None] * h, starts)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -30, 30)))
        return {"h": h, "t": t, "g": g, "w": w, "z": z, "y": y}

    def fit(self, texts: list[str | None], labels: list[int], steps: int = 250, rate: float = 0.01, l2: float = 1e-4) -> Model:
        y = np.array(labels, dtype=float)
        if len(set(labels)) < 2:
            self.rate = float(y.mean()) if len(y) else 0.0
            return self
        bags = [encode(t) for t in texts]
        x = np.concatenate(bags)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 0.05
        x = (x - self.mean) / self.scale
        sizes = np.array([len(b) for b in bags])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        of = np.repeat(np.arange(len(sizes)), sizes)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(u) for k, u in self.p.items()}
        for step in range(1, steps + 1):
            f, p = self._forward(x, starts, sizes), self.p
            dl = (f["y"] - y) / len(y)
            dz = dl[:, None] * p["c"]
            dw = (dz[of] * f["h"]).sum(axis=1)
            de = f["w"] * (dw - np.repeat(np.add.reduceat(f["w"] * dw, starts), sizes))
            du, dt = de[:, None] * p["a"] * f["t"] * f["g"] * (1 - f["g"]), de[:, None] * p["a"] * f["g"] * (1 - f["t"] ** 2)
            dh = (f["w"][:, None] * dz[of] + du @ p["U"].T + dt @ p["V"].T) * (f["h"] > 0)
            grad = {"W": x.T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ du, "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dl, "d": np.array([dl.sum()])}
            for k in p:
                g = grad[k] + l2 * p[k] * (k not in "bd")
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.rate is not None or not texts:
            return np.full(len(texts), self.rate or 0.0)
        out = np.empty(len(texts))
        for i in range(0, len(texts), 256):  # bounds the passages in memory
            bags = [encode(t) for t in texts[i : i + 256]]
            sizes = np.array([len(b) for b in bags])
            x = (np.concatenate(bags) - self.mean) / self.scale
            out[i : i + 256] = self._forward(x, np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)["y"]
        return out


def train(docs: DataFrame, labels: DataFrame, fold: Column, max_low: int = 600, max_high: int = 1800, **options) -> Model:
    """A model of at most ``max_low`` and ``max_high`` labelled documents of quality 0 and 1, whole texts."""
    rows = labelled_sample(docs, labels, "quality", fold, {0: max_low, 1: max_high})
    return Model(**options).fit([t for t, _ in rows], [y for _, y in rows])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted) for every row: the score of the whole text, and 1 from ``threshold`` on.

    Null and empty texts are scored as one empty passage. Without labelled rows of both kinds every
    score is the share of labels 1 (0 if there are none). Repeated rows each give a row; other
    columns are not read.
    """
    get = send(docs.sparkSession, model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = get()
        for b in batches:
            s = m.scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows whose text scores ``threshold`` or more; all columns as they were, repeated rows alike."""
    get = send(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = get()
        for b in batches:
            s = m.scores(b.column(b.schema.get_field_index(text_col)).to_pylist())
            yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
