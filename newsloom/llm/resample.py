"""Target-distribution importance resampling: draw the documents that look most like a target table.

A text's features are all runs of one to ``n`` consecutive words, hashed into buckets by crc32. A
bucket's gain is the log ratio of its smoothed shares in the target and in the corpus, a document's
weight the sum of its features' gains, and the draw takes the highest weights after Gumbel noise from
the id, which is a sample without replacement in proportion to the weights' exponentials.

Overlap chunking keeps tasks even: a text beyond ``LONG`` bytes is split at word boundaries into
chunks that own their starting positions and carry the next n-1 words, so that every run of words is
counted once, in the chunk of its first word. Chunks are dealt anew and summed by document; shorter
texts stay where they are read. Only bucket totals reach the driver, whatever the corpus holds. Ranks
need no global sort: rows are ranged over partitions, and each partition starts at the count of those
before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, send
from newsloom.llm.decontaminate import words

LONG = 1 << 16  # bytes of a text from which it is chunked
CHUNK = 1 << 13  # words that a chunk owns


def _pieces(own: int, n: int):
    """Arrow batches of (key, text) to chunks (key, part, owned, text): ``owned`` words of a chunk start runs, the rest are carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(*(b.column(c).to_pylist() for c in ("key", "text")), strict=True):
                ws = words(text)
                for part, i in enumerate(range(0, max(len(ws), 1), own)):
                    piece = b" ".join(ws[i : i + own + n - 1])
                    yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.string()), "part": pa.array([part], pa.int32()), "owned": pa.array([min(own, len(ws) - i)], pa.int32()), "text": pa.array([piece], pa.binary())})

    return run


def buckets_of(ws: list[bytes], owned: int, n: int, buckets: int) -> np.ndarray:
    """The buckets of all runs of 1 to n words that start in the first ``owned`` words; a run's crc32 goes on from that of the run without its last word."""
    spaced = [b" " + w for w in ws]
    crcs, found = list(map(crc32, ws)), []
    for k in range(n):
        if k:
            crcs = list(map(crc32, islice(spaced, k, None), crcs))
        found.append(islice(crcs, owned))
    return np.fromiter(chain.from_iterable(found), dtype=np.int64) % buckets


def _rows(b: pa.RecordBatch) -> Iterator[tuple[list[bytes], int]]:
    for text, owned in zip(b.column("text").to_pylist(), b.column("owned").to_pylist(), strict=True):
        ws = words(text) if text is None or isinstance(text, str) else text.split()
        yield ws, len(ws) if owned is None else owned


def _tally(n: int, buckets: int):
    """Arrow batches of texts to one (bucket, n) row for each bucket that the task met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for ws, owned in _rows(b):
                total += np.bincount(buckets_of(ws, owned, n, buckets), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": met, "n": total[met]})

    return run


def _weigh(get, n: int, buckets: int):
    """Each row of the Arrow batches with its number of words and features and the sum of their gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = get()
        for b in batches:
            made = [(owned, len(x := buckets_of(ws, owned, n, buckets)), int(gains[x].sum())) for ws, owned in _rows(b)]
            cols = [b.column(c) for c in b.schema.names if c not in ("text", "owned")]
            names = [c for c in b.schema.names if c not in ("text", "owned")]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([m[i] for m in made], pa.int64()) for i in range(3))], [*names, "n_words", "n_features", "weight"])

    return run


def _size(text_col: str) -> Column:
    return F.coalesce(F.octet_length(text_col), F.lit(0))


def _chunks(df: DataFrame, text_col: str, n: int, long: int, own: int) -> DataFrame:
    """(key, part, owned, text): the chunks of the texts beyond ``long`` bytes; the key is the text's digest."""
    texts = df.where(_size(text_col) > long).select(F.sha2(text_col, 256).alias("key"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_pieces(own, n), "key string, part int, owned int, text binary")


def bucket_counts(df: DataFrame, text_col: str = "text", n: int = 3, buckets: int = 10_000, long: int = LONG, own: int = CHUNK) -> DataFrame:
    """(bucket, n) of all features of all texts, repeats counted; a null or empty text has none."""
    tally, schema = _tally(n, buckets), "bucket long, n long"
    whole = df.where(_size(text_col) <= long).select(F.col(text_col).alias("text"), F.lit(None).cast("int").alias("owned"))
    dealt = _chunks(df, text_col, n, long, own).select("text", "owned").repartition(df.sparkSession.sparkContext.defaultParallelism * 4)
    found = whole.mapInArrow(tally, schema).unionByName(dealt.mapInArrow(tally, schema))
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's shares in target and corpus, add-one smoothed, rounded down."""
    s, t = (dict(map(tuple, df.collect())) for df in (corpus, target))  # a row for each bucket at most
    all_s, all_t = sum(s.values()), sum(t.values())
    ratio = lambda b: (t.get(b, 0) + 1.0) * (all_s + buckets) / ((s.get(b, 0) + 1.0) * (all_t + buckets))
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", n: int = 3, long: int = LONG, own: int = CHUNK) -> DataFrame:
    """(id, n_words, n_features, weight) for each row of ``docs``.

    A null or empty text weighs 0. Rows that repeat an id and text each keep a row of their own: their
    chunks are summed once and the sum is given to each.
    """
    run, key_type = _weigh(send(docs.sparkSession, gain), n, len(gain)), docs.schema[id_col].dataType.simpleString()
    short = docs.where(_size(text_col) <= long).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(None).cast("int").alias("owned"))
    short = short.mapInArrow(run, f"id {key_type}, n_words long, n_features long, weight long")
    parts = _chunks(docs, text_col, n, long, own).dropDuplicates(["key", "part"]).mapInArrow(run, "key string, part int, n_words long, n_features long, weight long")
    sums = parts.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")))
    owners = docs.where(_size(text_col) > long).select(F.col(id_col).alias("id"), F.sha2(text_col, 256).alias("key"))
    return short.unionByName(owners.join(sums, "key").drop("key")).withColumnRenamed("id", id_col)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", n: int = 3, buckets: int = 10_000, percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """(id, n_features, weight, score, rank) for each row of ``docs``; rank is null where a row isn't drawn.

    Drawn are the highest scores, ties to the smaller id (a null id first), of ``percent`` of the rows
    with at least ``min_words`` words. A null id takes part under the text 'null'. Rows with equal id
    and text tie and take neighbouring ranks. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    gain = gains(bucket_counts(docs, text_col, n, buckets), bucket_counts(target, target_col, n, buckets), buckets)
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0))))
    scored = weigh(docs, gain, id_col, text_col, n).withColumn("score", F.col("weight") + noise)
    order = [F.col("score").desc(), F.col(id_col).asc()]
    able = F.col("n_words") >= min_words
    scored = scratch.save(scored, "weighed")  # ranging reads its input twice
    ranged = scratch.save(scored.repartitionByRange(F.when(able, F.col("score")).desc_nulls_last(), F.col(id_col)).withColumn("_part", F.spark_partition_id()), "scored")
    scratch.drop("weighed")
    counts = ranged.where(able).groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = counts.withColumn("_before", F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).withColumn("_able", F.sum("_n").over(W.partitionBy()))
    rows = ranged.join(F.broadcast(before), "_part", "left")
    place = F.col("_before") + F.row_number().over(W.partitionBy("_part", able).orderBy(*order))
    rank = F.when(able & (place <= F.floor(F.col("_able") * percent / 100)), place).cast("long")
    return rows.select(id_col, "n_features", "weight", "score", rank.alias("rank"))
