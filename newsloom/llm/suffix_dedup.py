"""Exact substring dedup: every byte covered by a 100-byte string that also starts earlier goes.

A difference cover lets a suffix sort look at a sample of positions: two equal windows must meet in a
sampled position at the same offset. The cover used here is content-defined. In every window of
``length`` bytes the position of the least hash of its 48-byte strings is sampled, so equal windows
sample the same offset, as with a cover modulo v, but one position in 26 is sampled and not two in
three, and runs of windows share one.

1. Sample: each run of windows with one sampled position is a span; its name is (hash of the sampled
   string, hash of the span).
2. Sort by name and compare neighbours. A sampled string that occurs once ends its windows. A span
   that an equal span precedes goes whole, and is not looked at again.
3. Recurse on what is left: the first of each kind of span, where spans of several kinds share a
   sampled string. Their windows are named whole, sorted, and compared with their neighbours.

Texts never leave their tasks in steps 1 and 2, and the sorts hold names, not suffixes. A batch sends
one row for each of its span kinds, so a passage that stands in a third of all documents is a row for
each batch, not for each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch

GRAM = 48
_CHUNK = 1 << 20  # windows of a text handled at a time, which bounds memory for very long texts


def _bytes_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE, _SECOND = _bytes_table(20240229), _bytes_table(20260817)  # of two independent hashes
_STEP = np.uint64(0xD6E8FEB86659FD93)
_UNSTEP = np.uint64(pow(int(_STEP), -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Prefix:
    """Hashes of any substrings of one byte string, from prefix sums."""

    def __init__(self, b: np.ndarray, table: np.ndarray = _BYTE):
        self.n = len(b)
        power = np.full(self.n + 1, _STEP, dtype=np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        self.back = np.full(self.n + 1, _UNSTEP, dtype=np.uint64)  # takes a substring's place out of its sum
        self.back[0] = 1
        np.cumprod(self.back, out=self.back)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(table[b] * power[: self.n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start])

    def each(self, k: int) -> np.ndarray:
        m = self.n - k + 1
        return _mix((self.sums[k:] - self.sums[:m]) * self.back[:m])


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """The place of the least value (the leftmost of equals) in each w consecutive values."""
    at, v, size = np.arange(len(h)), h, 1
    while size < w:
        step = min(size, w - size)
        m = len(v) - step
        right = v[step:] < v[:m]
        at, v = np.where(right, at[step:], at[:m]), np.where(right, v[step:], v[:m])
        size += step
    return at


def spans(b: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """The spans of one text: gram, kind (hashes), start and n (its first window and number of windows)."""
    gram = min(GRAM, length)
    out: list[tuple] = []
    for first in range(0, len(b) - length + 1, _CHUNK):
        part = b[first : first + _CHUNK + length - 1]
        p = Prefix(part)
        h = p.each(gram)
        at = _least(h, length - gram + 1)
        start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        n = np.diff(np.concatenate([start, [len(at)]]))
        anchor = at[start]
        kind = Prefix(part, _SECOND).of(start, start + n - 1 + length) ^ _mix((anchor - start).astype(np.uint64) * _STEP)
        out.append((h[anchor].view(np.int64), kind.view(np.int64), start + first, n))
    cols = [np.concatenate(c) if out else np.zeros(0, dtype=np.int64) for c in (zip(*out, strict=True) if out else [[]] * 4)]
    return dict(zip(("gram", "kind", "start", "n"), cols, strict=True))


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def _seen_before(keys: list[np.ndarray]) -> np.ndarray:
    """For rows in order: whether an earlier row has the same keys."""
    order = np.lexsort((np.arange(len(keys[0])), *keys))
    same = np.ones(len(order), dtype=bool)
    for k in keys:
        same[1:] &= k[order][1:] == k[order][:-1]
    same[:1] = False
    out = np.zeros(len(order), dtype=bool)
    out[order] = same
    return out


def _merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Union of intervals."""
    out: list[list[int]] = []
    for a, b in sorted(zip(start.tolist(), end.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_NAMED = "gram long, kind long, id long, start long, n long, gone boolean"


def _rows(ids: np.ndarray, cols: dict[str, np.ndarray], length: int) -> pd.DataFrame:
    """Rows to sort: spans not seen earlier in the batch; the others as intervals to remove."""
    seen = _seen_before([cols["gram"], cols["kind"]])
    many = np.isin(np.arange(len(seen)), np.flatnonzero(~seen))
    kept = pd.DataFrame({"gram": cols["gram"][many], "kind": cols["kind"][many], "id": ids[many], "start": cols["start"][many], "n": cols["n"][many], "gone": False})
    gone = []
    for i in np.unique(ids[seen]):
        of = seen & (ids == i)
        gone += [(i, a, b - a) for a, b in _merged(cols["start"][of], cols["start"][of] + cols["n"][of] - 1 + length)]
    lost = pd.DataFrame(gone, columns=["id", "start", "n"], dtype="int64")
    # spread over the partitions by a name of their own; nothing shares it
    lost["gram"] = _mix(lost["id"].to_numpy().astype(np.uint64) * _STEP + lost["start"].to_numpy().astype(np.uint64)).view(np.int64) if len(lost) else 0
    return pd.concat([kept, lost.assign(kind=lost["start"], gone=True)])[["gram", "kind", "id", "start", "n", "gone"]].astype({"gram": "int64", "kind": "int64", "gone": "bool"})


def _sorted_batch(b: pd.DataFrame) -> pd.DataFrame:
    return b.sort_values("id", kind="stable")


def intervals(docs: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """(id, start, end) of byte ranges to remove, of documents (id long and unique, text); ranges may overlap."""

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = _sorted_batch(b)
            found = [spans(_bytes(t), length) for t in b["text"]]
            ids = np.repeat(b["id"].to_numpy(), [len(x["n"]) for x in found])
            if len(ids):
                yield _rows(ids, {k: np.concatenate([x[k] for x in found]) for k in found[0]}, length)

    named = docs.select("id", "text").mapInPandas(sample, _NAMED)
    kinds = W.partitionBy("gram", "kind").orderBy("id", "start")
    ranked = named.repartition("gram").withColumn("rank", F.row_number().over(kinds))
    ranked = ranked.withColumn("kinds", F.sum(F.when((F.col("rank") == 1) & ~F.col("gone"), 1)).over(W.partitionBy("gram")))
    level = scratch.save(ranked.where("gone OR rank > 1 OR kinds > 1").select("id", "start", "n", F.when(F.col("gone"), 0).when(F.col("rank") > 1, 1).otherwise(2).alias("what")), "spans")
    first = level.where("what = 0").select("id", "start", (F.col("start") + F.col("n")).alias("end"))
    whole = level.where("what = 1").select("id", "start", (F.col("start") + F.col("n") - 1 + length).alias("end"))
    open_ = level.where("what = 2").groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("open"))

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = _sorted_batch(b)
            names, kinds, starts, ids = [], [], [], []
            for r in b.itertuples():
                raw = _bytes(r.text)
                for s in r.open:
                    part = raw[s["start"] : s["start"] + s["n"] - 1 + length]
                    names.append(Prefix(part).each(length).view(np.int64))
                    kinds.append(Prefix(part, _SECOND).each(length).view(np.int64))
                    starts.append(np.arange(s["start"], s["start"] + s["n"]))
                    ids.append(np.full(s["n"], r.id))
            if names:
                name = np.concatenate(names)
                # two names of independent hashes, so that equal means equal at any size
                cols = {"gram": name, "kind": np.concatenate(kinds), "start": np.concatenate(starts), "n": np.ones(len(name), dtype=np.int64)}
                ids = np.concatenate(ids)
                order = np.lexsort((cols["start"], ids))
                rows = _rows(ids[order], {k: v[order] for k, v in cols.items()}, length)
                yield rows.assign(kind=(rows["kind"] & 0x7FFFFFFF).astype("int32"))  # 95 bits of name are enough, and less to shuffle

    fine = docs.join(open_, "id").select("id", "text", "open").mapInPandas(windows, _NAMED.replace("kind long", "kind int"))
    again = fine.withColumn("before", F.lag("gram").over(W.partitionBy("gram", "kind").orderBy("id", "start"))).where("gone OR before IS NOT NULL")
    late = again.select("id", "start", F.when(F.col("gone"), F.col("start") + F.col("n")).otherwise(F.col("start") + length).alias("end"))
    return first.unionByName(whole).unionByName(late)


def _cut(text: str | None, ranges: list) -> tuple[bytes, int, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not len(ranges):
        return raw, 0, 0
    union = _merged(np.array([r["start"] for r in ranges]), np.array([r["end"] for r in ranges]))
    kept, at = [], 0
    for a, b in union:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return b"".join(kept), sum(b - a for a, b in union), len(union)


def _with_ranges(docs: DataFrame, length: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "suffix")
    ranges = intervals(docs.where("id is not null"), scratch, length).groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    return docs.join(ranges, "id", "left").withColumn("ranges", F.coalesce("ranges", F.array().cast("array<struct<start:long,end:long>>")))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, null counts as empty, and matches never cross documents. A byte goes if a
    string of ``length`` bytes over it also starts earlier, in a smaller id or earlier in the same
    document; strings may overlap and are judged on the input. Ids are integers; rows repeated under
    one id are one document (the first text by order), and a null id has no place in the order, so
    its row loses nothing. Texts shorter than ``length`` lose nothing. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    docs = docs.where("id is not null").groupBy("id").agg(F.min("text").alias("text")).unionByName(docs.where("id is null")) if _repeats(docs) else docs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                kept, removed, n = _cut(r.text, r.ranges)
                rows.append((r.id, len(kept) + removed, removed, n, hashlib.sha256(kept).hexdigest()))
            out = pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            yield out.astype({"id": "Int64"})

    out = _with_ranges(docs, length).mapInPandas(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


def _repeats(docs: DataFrame) -> bool:
    return bool(docs.where("id is not null").groupBy("id").count().where("count > 1").limit(1).count())


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """All rows and columns of ``docs``, the texts without the bytes that ``report`` removes.

    As there, rows repeated under one id are one document, the first text by order: a row with that
    text loses what the document loses, and a row with another text keeps all. Null ids and null texts
    stay as they are. A cut may split a character; its remaining bytes are replaced by U+FFFD, as a
    string can't hold them. An empty table gives an empty result.
    """
    one = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(text_col).alias("text"))
    ranges = _with_ranges(one, length).where("size(ranges) > 0").select(F.col("id").alias("_cut_id"), F.xxhash64("text").alias("_cut_text"), F.col("ranges").alias("_cut"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or c is None else _cut(t, c)[0].decode("utf-8", "replace") for t, c in zip(texts, cuts, strict=True)], dtype=object)

    held = docs.join(ranges, (F.col(id_col).cast("long") == F.col("_cut_id")) & (F.xxhash64(text_col) == F.col("_cut_text")), "left")
    return held.withColumn(text_col, F.when(F.col("_cut_id").isNull(), F.col(text_col)).otherwise(cut(text_col, F.col("_cut")))).select(docs.columns)
