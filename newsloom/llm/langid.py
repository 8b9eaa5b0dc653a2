"""Language identification with script ranges and Viterbi labelling of mixed-language text.

A word's script narrows its candidate languages to those seen in that script. Character n-grams score
the word in each candidate; Viterbi over the words, with a penalty for switching, labels spans. The
document's language is the one with the most letters in its spans.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from newsloom.llm.common import send

_WORD = re.compile(r"[^\W\d_]+")  # may hold number signs such as superscripts, see words_of
_BUCKETS = 1 << 16
# First code points of runs of one script; the number names the script, 0 is none of these.
_SCRIPT_STARTS = [
    (0x0000, 1), (0x0250, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 0), (0x0750, 6), (0x0780, 0), (0x0900, 7), (0x0980, 8), (0x0A00, 9), (0x0A80, 10), (0x0B00, 0),
    (0x0B80, 11), (0x0C00, 12), (0x0C80, 13), (0x0D00, 14), (0x0D80, 15), (0x0E00, 16), (0x0E80, 17), (0x0F00, 18), (0x1000, 19), (0x10A0, 20), (0x1100, 21), (0x1200, 22), (0x1380, 0), (0x1780, 23),
    (0x1800, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 24), (0x3100, 0), (0x3130, 21), (0x3190, 0), (0x3400, 25), (0xA000, 0), (0xAC00, 21), (0xD7B0, 0), (0xF900, 25), (0xFB00, 0),
    (0x20000, 25), (0x30000, 0),
]
_STARTS = np.array([a for a, _ in _SCRIPT_STARTS])
_SCRIPTS = np.array([b for _, b in _SCRIPT_STARTS])


def words_of(text: str | None) -> list[str]:
    """The runs of letters, as str.isalpha has them, of the lower-cased text: number signs are no letters."""
    found = _WORD.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


def _grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word number, bucket) of the byte n-grams, n from 2 to 5, and of the whole of each word."""
    import zlib

    raw = (" " + " ".join(words) + " ").encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64)
    gap = b == 32
    of = np.cumsum(gap) - 1
    for n in (2, 3, 4, 5):
        if len(b) < n:
            continue
        m = len(b) - n + 1
        h = np.full(m, n, dtype=np.uint64)
        ok = np.ones(m, dtype=bool)
        for i in range(n):
            h = (h ^ b[i : i + m]) * np.uint64(0x100000001B3)
            if 0 < i < n - 1:
                ok &= ~gap[i : i + m]
        ok &= ~(gap[:m] & gap[n - 1 :])
        h ^= h >> np.uint64(23)
        yield of[:m][ok], (h[ok] % np.uint64(_BUCKETS)).astype(np.int64)
    yield np.arange(len(words)), np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % _BUCKETS for w in words], dtype=np.int64)


class Model:
    def __init__(self, switch_penalty: float = 8.0, weight: float = 0.4, cap: float = 6.0):
        self.penalty, self.weight, self.cap = switch_penalty, weight, cap
        self.langs: list[str] = []
        self._cache: dict[str, int] = {}  # a word's row in _rows
        self._rows = np.zeros((0, 0), dtype=np.float32)

    def __getstate__(self):
        return {**self.__dict__, "_cache": {}, "_rows": np.zeros((0, 0), dtype=np.float32)}

    def fit(self, texts: list[str | None], langs: list[str]) -> Model:
        """Learn the languages, the scripts each is written in, and its n-grams."""
        self.langs = sorted(set(langs))
        words = {k: Counter() for k in self.langs}
        for t, k in zip(texts, langs, strict=True):
            words[k].update(words_of(t))
        self.table = np.zeros((len(self.langs), _BUCKETS))
        self.scripts = np.zeros((len(self.langs), _SCRIPTS.max() + 1), dtype=bool)
        for i, k in enumerate(self.langs):
            if not words[k]:
                continue
            w, n = list(words[k]), np.fromiter(words[k].values(), dtype=float)
            for of, bucket in _grams(w):
                self.table[i] += np.bincount(bucket, weights=n[of], minlength=_BUCKETS)
            share = np.bincount(self._script(w), weights=n * [len(x) for x in w], minlength=self.scripts.shape[1])
            self.scripts[i] = share > 0.02 * share.sum()
        self.table = np.log((self.table + 0.5) / (self.table.sum(axis=1, keepdims=True) + 0.5 * _BUCKETS)).astype(np.float32)
        return self

    @staticmethod
    def _script(words: list[str]) -> np.ndarray:
        return _SCRIPTS[np.searchsorted(_STARTS, [ord(w[0]) for w in words], side="right") - 1]

    def _scores(self, words: set[str]) -> None:
        """Scores of new words into the cache: against the best candidate, not below the cap."""
        ws = list(words)
        if not ws:
            return
        total = np.zeros((len(self.langs), len(ws)))
        for of, bucket in _grams(ws):
            for i in range(len(self.langs)):
                total[i] += np.bincount(of, weights=self.table[i, bucket], minlength=len(ws))
        total *= self.weight
        candidates = self.scripts[:, self._script(ws)]
        total[~candidates] = -1e9
        total = np.maximum(total - total.max(axis=0), -self.cap).T
        total[~candidates.any(axis=0)] = 0
        first = len(self._cache)
        if first + len(ws) > len(self._rows):
            grown = np.zeros((2 * (first + len(ws)), len(self.langs)), dtype=np.float32)
            if first:
                grown[:first] = self._rows[:first]
            self._rows = grown
        self._rows[first : first + len(ws)] = total
        self._cache.update(zip(ws, range(first, first + len(ws)), strict=True))

    def paths(self, texts: list[str | None]) -> list[tuple[list[str], np.ndarray]]:
        """The words of each text and the number of the language Viterbi gives each."""
        bags = [words_of(t) for t in texts]
        if len(self._cache) > 500_000:
            self._cache.clear()
        out: list = [(b, np.zeros(0, dtype=np.int64)) for b in bags]
        order = sorted((i for i, b in enumerate(bags) if b), key=lambda i: -len(bags[i]))
        at = 0
        while at < len(order):
            n = max(1, min(len(order) - at, 400_000 // len(bags[order[at]])))  # bounds words times documents
            part = order[at : at + n]
            at += n
            self._scores({w for i in part for w in bags[i]} - self._cache.keys())
            self._viterbi(part, bags, out)
        return out

    def _viterbi(self, part: list[int], bags: list[list[str]], out: list) -> None:
        sizes = np.array([len(bags[i]) for i in part])  # in falling order
        steps, k = sizes[0], len(self.langs)
        e = np.zeros((len(part), steps, k), dtype=np.float32)
        for row, i in enumerate(part):
            e[row, : sizes[row]] = self._rows[np.fromiter(map(self._cache.__getitem__, bags[i]), dtype=np.int64, count=sizes[row])]
        active = np.searchsorted(-sizes, -np.arange(steps), side="left")  # documents longer than step t
        v = e[:, 0].copy()
        moved = np.zeros((steps, len(part), k), dtype=bool)
        came = np.zeros((steps, len(part)), dtype=np.int16)
        for t in range(1, steps):
            n = active[t]
            best = v[:n].argmax(axis=1)
            top = v[np.arange(n), best] - self.penalty
            moved[t, :n] = top[:, None] > v[:n]
            came[t, :n] = best
            v[:n] = np.maximum(v[:n], top[:, None]) + e[:n, t]
        state = v.argmax(axis=1)
        path = np.zeros((len(part), steps), dtype=np.int64)
        for t in range(steps - 1, -1, -1):
            n = active[t]
            path[:n, t] = state[:n]
            if t:
                rows = np.arange(n)
                state[:n] = np.where(moved[t, rows, state[:n]], came[t, :n], state[:n])
        for row, i in enumerate(part):
            out[i] = (bags[i], path[row, : sizes[row]])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        found = []
        for words, path in self.paths(texts):
            if not words:
                found.append(("und", 0.0))
                continue
            letters = np.bincount(path, weights=[len(w) for w in words], minlength=len(self.langs))
            i = int(letters.argmax())
            found.append((self.langs[i], float(letters[i] / letters.sum())))
        return found

    def spans(self, texts: list[str | None]) -> list[list[dict]]:
        """Runs of words of one language: first word, number of words, language."""
        out = []
        for words, path in self.paths(texts) if self.langs else [([], np.zeros(0))] * len(texts):
            cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(words)] if words else []
            out.append([{"first_word": a, "n_words": b - a, "lang": self.langs[int(path[a])]} for a, b in zip(cuts, cuts[1:], strict=False)])
        return out


def train(docs: DataFrame, fold: Column, per_lang: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Model:
    """A model of at most ``per_lang`` whole texts of each language among the rows where ``fold`` is true.

    Those first by hash of their id are taken. Rows with a null language, id or text teach nothing.
    """
    usable = docs.where(fold & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64(F.col("id").cast("string")), "id"))
    drawn = usable.withColumn("n", place).where(F.col("n") <= per_lang).select("id").distinct()
    texts = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = sorted((r[1] or "", r[2]) for r in texts.join(F.broadcast(drawn), "id").collect())  # bounded by per_lang
    return Model(**options).fit([t for t, _ in rows], [k for _, k in rows])


def _apply(docs: DataFrame, model: Model, id_col: str, text_col: str, call: str, fields: str, types: list[pa.DataType]) -> DataFrame:
    get = send(docs.sparkSession, model)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [f.strip().split(" ")[0] for f in fields.split("; ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = get()
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                rows = getattr(m, call)(b.column(1).to_pylist())
                cols = list(zip(*rows, strict=True)) if len(types) > 1 else [rows]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in zip(cols, types, strict=True))], names=["id", *names])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {fields.replace('; ', ', ')}").withColumnRenamed("id", id_col)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row: the whole text's language and its share of the letters.

    Null texts and texts without letters give ``und`` and 0, as does a model that has learned no
    language. Ties go to the language first in order. Repeated rows each give a row.
    """
    return _apply(docs, model, id_col, text_col, "predict", "lang_pred string; score double", [pa.string(), pa.float64()])


def label_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row: the runs of words of one language in text order.

    Null and empty texts, texts without letters and a model that has learned no language give no spans.
    Repeated rows each give a row; an empty table gives an empty result; other columns are not read.
    """
    span = pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("lang", pa.string())])
    return _apply(docs, model, id_col, text_col, "spans", "spans array<struct<first_word:long,n_words:long,lang:string>>", [pa.list_(span)])
