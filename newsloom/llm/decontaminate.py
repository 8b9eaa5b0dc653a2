"""Benchmark decontamination: remove training text that contains windows of test items.

The windows of the test items (ten consecutive normalised words; a shorter item is one window) form
a hash set that is broadcast when its counted size is below ``max_broadcast_windows``. Tasks scan
the word windows of each document: words map to the ids of the item vocabulary, windows with an
unknown word can't match, the rest are looked up by a rolling hash and verified word by word. A
larger item set is not broadcast: windows are joined on their hash by a shuffle and then verified.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, send

WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in WORD_BYTES else 32 for c in range(256))
_MUL = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Normalised words: A-Z lower-cased, runs of digits, letters and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows(tokens: list[bytes], n: int) -> list[tuple[bytes, ...]]:
    if not tokens:
        return []
    return [tuple(tokens[i : i + n]) for i in range(max(1, len(tokens) - n + 1))]


class Matcher:
    """The windows of the items, and a scan of one document against them."""

    def __init__(self, items: list[tuple[object, str]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], set] = {}
        number = self.vocabulary.setdefault
        for item, text in items:
            for w in windows(words(text), n):
                self.items.setdefault(tuple(number(x, len(self.vocabulary)) for x in w), set()).add(item)
        self.hashes = {}
        for k in {len(w) for w in self.items}:
            rows = np.array([w for w in self.items if len(w) == k], dtype=np.int64)
            self.hashes[k] = np.unique(self._roll(rows.ravel(), k)[::k])

    @staticmethod
    def _roll(ids: np.ndarray, k: int) -> np.ndarray:
        """A hash of each k consecutive ids."""
        x = (ids.astype(np.uint64) + np.uint64(1)) * _MUL
        x ^= x >> np.uint64(29)
        h = np.zeros(len(ids) - k + 1, dtype=np.uint64)
        for i in range(k):
            h = h * np.uint64(0x100000001B3) + x[i : i + len(h)]
        return h

    def hits(self, tokens: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words of the document any window covers, and the items those windows are of."""
        n = len(tokens)
        found: set = set()
        hit = np.zeros(n, dtype=bool)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in tokens), dtype=np.int64, count=n)
        unknown = np.cumsum(np.concatenate([[0], ids < 0]))
        for k, known in self.hashes.items():
            if n < k:
                continue
            starts = np.flatnonzero(unknown[k:] == unknown[:-k])
            if not len(starts):
                continue
            h = self._roll(ids, k)[starts]
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for s in starts[known[at] == h].tolist():
                of = self.items.get(tuple(ids[s : s + k].tolist()))
                if of:
                    hit[s : s + k] = True
                    found |= of
        return hit, found


_COLUMNS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _row(n_words: int, n_hit: int, found: set) -> tuple:
    joined = ",".join(sorted(map(str, found)))
    return n_words, n_hit, len(found), hashlib.sha256(joined.encode()).hexdigest(), n_hit > 0


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 10, max_broadcast_windows: int = 2_000_000) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null, empty and wordless texts have no words and no hits; so have wordless items, and rows of
    items with a null id are left out. Repeated rows each give a row. Other columns aren't read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    if _bound(items) > max_broadcast_windows:
        return _joined(docs, items, kind, id_col, n)
    matcher = send(docs.sparkSession, Matcher([tuple(r) for r in items.collect()], n))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher()
        for b in batches:
            rows = []
            for x in b.column(1):
                w = words(x.as_py())
                hit, found = m.hits(w)
                rows.append(_row(len(w), int(hit.sum()), found))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return docs.mapInArrow(scan, f"id {kind}, {_COLUMNS}").withColumnRenamed("id", id_col)


def _window_hits(docs: DataFrame, items: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """(row, k, i, item): the windows of k words from word i on of documents (row, text) that are windows of an item, by a shuffle on their hash."""
    item_kind, row_kind = (d.schema[c].dataType.simpleString() for d, c in ((items, "item"), (docs, "row")))

    def cut(w: list[bytes], k: int) -> Iterator[tuple[int, int, str]]:
        import xxhash

        for i in range(len(w) - k + 1):
            s = b" ".join(w[i : i + k])
            yield i, xxhash.xxh64_intdigest(s, k) - (1 << 63), s.decode("utf-8", "surrogatepass")

    def of_items(batches):
        for b in batches:
            rows = [(r.item, min(n, len(w)), h, s) for r in b.itertuples() if (w := words(r.text)) for _, h, s in cut(w, min(n, len(w)))]
            if rows:
                yield _frame(rows, ["item", "k", "h", "window"])

    known = scratch.save(items.mapInPandas(of_items, f"item {item_kind}, k int, h long, window string").distinct(), "items")
    ks = sorted(r.k for r in known.select("k").distinct().collect())  # n lengths at most

    def of_docs(batches):
        for b in batches:
            for r in b.itertuples():
                w = words(r.text)
                rows = [(r.row, k, i, h, s) for k in ks for i, h, s in cut(w, k)]
                if rows:
                    yield _frame(rows, ["row", "k", "i", "h", "window"])

    return docs.mapInPandas(of_docs, f"row {row_kind}, k int, i long, h long, window string").join(known, ["k", "h", "window"]).select("row", "k", "i", "item")


def _joined(docs: DataFrame, items: DataFrame, kind: str, id_col: str, n: int) -> DataFrame:
    """The report for item sets too large to broadcast."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    rows = scratch.save(docs.withColumn("row", F.monotonically_increasing_id()), "docs")
    hits = _window_hits(rows.select("row", "text"), items, n, scratch)
    per_item = hits.groupBy("row").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("found"))
    at = hits.select("row", F.explode(F.sequence(F.col("i"), F.col("i") + F.col("k") - 1)).alias("at")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))

    def count(batches):
        for b in batches:
            yield _frame([(r.row, r.id, len(words(r.text))) for r in b.itertuples()], ["row", "id", "n_words"])

    every = rows.select("row", "id", "text").mapInPandas(count, f"row long, id {kind}, n_words long")
    found = F.coalesce("found", F.array().cast("array<string>"))
    return every.join(per_item, "row", "left").join(at, "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(found).cast("long").alias("n_items"), F.sha2(F.array_join(found, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")
    )


def _frame(rows: list[tuple], names: list[str]):
    import pandas as pd

    return pd.DataFrame(rows, columns=names)


def drop_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 10, max_broadcast_windows: int = 2_000_000) -> DataFrame:
    """The documents with no window of any item; all columns as they were. Null and empty texts stay."""
    items = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    if _bound(items) > max_broadcast_windows:
        # beyond the broadcast bound rows are told apart by their text
        key = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
        bad = report(docs.select(key.alias("key"), F.col(text_col).alias("text")), items, "key", "text", "item", "text", n, max_broadcast_windows)
        bad = bad.where("contaminated").select(F.col("key").alias("_newsloom_key")).distinct()
        return docs.withColumn("_newsloom_key", key).join(bad, "_newsloom_key", "left_anti").select(docs.columns)
    matcher = send(docs.sparkSession, Matcher([tuple(r) for r in items.collect()], n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher()
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col))
            yield b.filter(pa.array([not m.hits(words(x.as_py()))[0].any() for x in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _bound(items: DataFrame) -> float:
    """At least as many windows as the items have: a word takes two bytes of the text, itself and a separator."""
    return items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0


def remove_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 10, max_broadcast_windows: int = 2_000_000) -> DataFrame:
    """The documents with the characters of every hit word removed from the text; the rest of the text stays as it was.

    Null, empty and wordless texts stay as they are, repeated rows alike; wordless items and those of a
    null id hit nothing. Beyond the broadcast bound hit words come from the join of windows, by the
    text's digest. All columns are kept.
    """
    items = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    if _bound(items) > max_broadcast_windows:
        key = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
        hits = _window_hits(docs.select(key.alias("row"), F.col(text_col).alias("text")), items, n, Scratch(docs.sparkSession, "decontaminate"))
        at = hits.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("i"), F.col("i") + F.col("k") - 1)))).alias("_hit_words"))

        @F.pandas_udf("string")
        def cut(texts, hit):
            return texts.combine(hit, lambda t, h: t if t is None or h is None else _without_words(t, lambda words_: np.isin(np.arange(len(words_)), h)))

        joined = docs.withColumn("_newsloom_key", key).join(at.withColumnRenamed("row", "_newsloom_key"), "_newsloom_key", "left")
        return joined.withColumn(text_col, cut(F.col(text_col), F.col("_hit_words"))).select(docs.columns)
    matcher = send(docs.sparkSession, Matcher([tuple(r) for r in items.collect()], n))

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else _without_words(t, lambda w: matcher().hits(w)[0]), na_action=None)

    return docs.withColumn(text_col, clean(F.col(text_col)))


_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _without_words(text: str, hits) -> str:
    """The text without the words that ``hits``, given all of its words, marks."""
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.translate(_TABLE)
    at = [x.span() for x in _WORD.finditer(low)]
    keep = np.ones(len(raw), dtype=bool)
    for (a, b), h in zip(at, hits([low[a:b] for a, b in at]), strict=True):
        if h:
            keep[a:b] = False
    return text if keep.all() else np.frombuffer(raw, dtype=np.uint8)[keep].tobytes().decode("utf-8", "surrogatepass")
