"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Vectors are centred, turned by a rotation learned on a bounded sample (principal axes, then iterative
quantisation), and cut to sign bits. A code is split into substrings and each substring is indexed.
Two codes within radius r agree in some substring up to r // (number of substrings) bits (pigeonhole), so
probing every substring value that near retrieves every code within r; their vectors are then ranked
by exact distance.

Queries meet all rows in blocks: rows are hashed into row blocks, queries into query blocks, and each
pair of blocks is one group, indexed and searched in its task. Each block gives its nearest rows of a
query, and the nearest of those are the result. The radius is that within which the sample's true
neighbours lie; a query with fewer than k codes within it in a block gets a wider one there, up to
the whole block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, send

SUBSTRING_BITS = 16


class Codes:
    """A learned rotation; ``of`` gives the codes of vectors as words of 16 bits."""

    def __init__(self, bits: int = 64, rounds: int = 30, seed: int = 3):
        self.bits, self.rounds, self.seed = bits, rounds, seed
        self.radius = 0

    def fit(self, x: np.ndarray, k: int, coverage: float = 0.95) -> Codes:
        rng = np.random.default_rng(self.seed)
        d = x.shape[1]
        self.bits = bits = max(SUBSTRING_BITS, min(self.bits, d) // SUBSTRING_BITS * SUBSTRING_BITS)
        self.mean = x.mean(axis=0)
        y = x - self.mean
        axes = np.linalg.eigh(y.T @ y)[1][:, ::-1][:, : min(bits, d)]  # as large as the dimensions, not the sample
        if axes.shape[1] < bits:  # fewer dimensions than bits: random directions fill up
            axes = np.hstack([axes, rng.normal(size=(d, bits - axes.shape[1])) / np.sqrt(d)])
        v = y @ axes
        r = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
        for _ in range(self.rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        self.turn = axes @ r
        # the radius within which the sample's true neighbours lie
        code, ask = self.of(x), rng.permutation(len(x))[:500]
        far = []
        for i in ask:
            dist = ((x - x[i]) ** 2).sum(axis=1)
            dist[i] = np.inf
            near = np.argsort(dist, kind="stable")[: min(k, len(x) - 1)]
            far.append(np.bitwise_count(code[near] ^ code[i]).sum(axis=1))
        far = np.concatenate(far) if far else np.zeros(1)
        self.radius = int(np.quantile(far, coverage)) if len(far) else bits
        return self

    def of(self, x: np.ndarray) -> np.ndarray:
        b = np.packbits((x - self.mean) @ self.turn >= 0, axis=1)
        return np.ascontiguousarray(b).view(np.uint16)


def _masks(radius: int) -> np.ndarray:
    """All 16-bit words with at most ``radius`` bits, fewest first."""
    words = np.arange(1 << SUBSTRING_BITS, dtype=np.uint32)
    n = np.bitwise_count(words)
    order = np.argsort(n, kind="stable")
    return words[order][: int((n <= radius).sum())]


class BlockIndex:
    """The substring tables of one block of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.m = codes, codes.shape[1]
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(self.m)]
        self.sizes = [np.bincount(codes[:, j], minlength=1 << SUBSTRING_BITS) for j in range(self.m)]
        self.starts = [np.cumsum(n) - n for n in self.sizes]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows of every code within ``radius`` of ``code``.

        Of m substrings, either one of the first (radius mod m) + 1 differs in at most radius // m
        bits, or one of the others in at most one bit fewer; so these values are probed.
        """
        found = []
        for j in range(self.m):
            near = radius // self.m - (j > radius % self.m)
            if near < 0:
                continue
            probe = _masks_of(near) ^ np.uint32(code[j])
            a, n = self.starts[j][probe], self.sizes[j][probe]
            a, n = a[n > 0], n[n > 0]
            at = np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)
            found.append(self.order[j][at])
        seen = np.zeros(len(self.codes), dtype=bool)
        for rows in found:
            seen[rows] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]


_MASKS: dict[int, np.ndarray] = {}


def _masks_of(radius: int) -> np.ndarray:
    radius = min(radius, SUBSTRING_BITS)
    if radius not in _MASKS:
        _MASKS[radius] = _masks(radius)
    return _MASKS[radius]


def search_block(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, codes: Codes, k: int) -> pd.DataFrame:
    """The k nearest rows of one block for each query, the query's own row apart."""
    index, bits = BlockIndex(codes.of(x)), codes.bits
    asked = codes.of(q)
    out = []
    for qi, qv, qc in zip(q_ids, q, asked, strict=True):
        radius = codes.radius
        while True:
            rows = index.within(qc, radius)
            rows = rows[ids[rows] != qi]
            if len(rows) >= k or radius >= bits:
                break
            radius = min(bits, radius + index.m)
        dist = np.sqrt(((x[rows] - qv) ** 2).sum(axis=1))
        best = np.lexsort((ids[rows], dist))[:k]
        out.append(pd.DataFrame({"query_id": qi, "vec_id": ids[rows][best], "score": dist[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part: the id and vector are there, finite, not zero."""
    v = F.col(vector_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    return vectors.where(ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def nearest(vectors: DataFrame, queries_where: str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found of each query, by Euclidean distance.

    Queries are the rows where ``queries_where``, a condition on id, holds; a query's own id is no
    candidate. Rows with a null id or a vector that is null, empty, zero, not finite or holds nulls take
    no part. Vectors have a distance to those of their own length only: each length has its own codes and
    index. Ties go to the smaller id. Rows repeated under one id are one row (the smallest vector by
    order). Fewer than k candidates are all returned; an empty table gives an empty result; other columns
    are not read. ``options`` are those of ``nearest_of_length``.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = scratch.save(usable(vectors, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v")).withColumn("d", F.size("v")), "rows")
    lengths = [r.d for r in rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy("d").collect()]  # of vectors: a table has few
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for i, d in enumerate(lengths):
        part = nearest_of_length(rows.where(F.col("d") == d).select("id", "v"), queries_where, k, **options)
        found = part if i == 0 else found.unionByName(part)
    return found


def nearest_of_length(rows: DataFrame, queries_where: str, k: int = 10, sample_rows: int = 8192, block_rows: int = 8192, block_queries: int = 4096, coverage: float = 0.95) -> DataFrame:
    """As ``nearest``, of written rows (id, v) with one vector for each id, all of one length.

    The rotation is fitted on ``sample_rows`` rows at most; every row is indexed.
    """
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    schema = "query_id long, vec_id long, score double"
    get = send(spark, Codes().fit(np.array([r.v for r in sample]), k, coverage))
    asked = rows.where(queries_where)
    n_rows, n_asked = rows.count(), asked.count()
    rb, qb = -(-n_rows // block_rows), max(1, -(-n_asked // block_queries))
    hashed = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("rb", hashed(rb)).withColumn("qb", all_of(qb))
    right = asked.withColumn("qb", hashed(qb)).withColumn("rb", all_of(rb))

    def search(block: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(ask):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_block(block["id"].to_numpy(), np.stack(block["v"].to_numpy()), ask["id"].to_numpy(), np.stack(ask["v"].to_numpy()), get(), k)

    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(search, schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
