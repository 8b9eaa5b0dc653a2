"""Selection: per-section pools, finals, backfill, round robin, stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: str | list[str], order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """The first k rows of each group by ``order`` (which must break ties), with their rank."""
    by = W.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(by)).where(F.col(rank_col) <= k)


def first_per_key(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key; rows with an empty or null key all stay."""
    k = F.coalesce(key, F.lit(""))
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(F.when(k == "", F.uuid()).otherwise(k)).orderBy(*order))).where("_rn = 1").drop("_rn")


def claimed_per_section(df: DataFrame, section_pos: str, rank: str, key: str, k: int) -> DataFrame:
    """k rows per section where a key in several sections counts for the first section only."""
    owned = df.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(section_pos, rank))).where("_rn = 1").drop("_rn")
    return top_per_group(owned, section_pos, [F.col(rank)], k, "fetch_rank")


def underfilled(finals: DataFrame, sections: DataFrame, section: str, least: int) -> DataFrame:
    """(section, n, deficit) of sections below ``least``, empty ones too."""
    n = finals.groupBy(section).agg(F.count(F.lit(1)).alias("n"))
    out = sections.select(section).join(n, section, "left").select(section, F.coalesce("n", F.lit(0)).alias("n"))
    return out.where(F.col("n") < least).withColumn("deficit", least - F.col("n"))


def backfill(pool: DataFrame, taken: DataFrame, short: DataFrame, section: str, key: str, order: list[Column], per_section: int = 8, total: int = 20) -> DataFrame:
    """Untaken rows of the short sections, up to ``per_section`` each and ``total`` in all."""
    free = pool.join(taken.select(key).distinct(), key, "left_anti").join(F.broadcast(short.select(section)), section, "left_semi")
    best = top_per_group(free, section, order, per_section, "fill_rank")
    return best.orderBy("fill_rank", section, *order).limit(total)


def round_robin(df: DataFrame, method: str, method_pos: str, query: str, ordinal: str, limit: int) -> DataFrame:
    """Distinct queries taken in turn from the methods: the first of each, then the second, up to ``limit``."""
    once = df.withColumn("_rn", F.row_number().over(W.partitionBy(query).orderBy(method_pos, ordinal))).where("_rn = 1").drop("_rn")
    turn = once.withColumn("turn", F.row_number().over(W.partitionBy(method).orderBy(ordinal)))
    picked = turn.orderBy("turn", method_pos).limit(limit)
    return picked.withColumn("request_no", F.row_number().over(W.orderBy("turn", method_pos)))  # at most ``limit`` rows


def stratified_sample(df: DataFrame, stratum: str, order: list[Column], max_items: int) -> DataFrame:
    """Evenly spaced rows of each stratum, its quota in proportion to its size and one at least.

    The quota of a stratum of c of n rows is greatest(1, floor(max_items * c / n)), c at most; its
    i-th pick (from 0) is row floor(i * c / quota) in order.
    """
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_c"))
    total = sizes.agg(F.sum("_c").alias("_n"))
    quota = sizes.crossJoin(F.broadcast(total)).withColumn("_q", F.least("_c", F.greatest(F.lit(1), F.floor(F.col("_c") * max_items / F.col("_n")))))  # one row of totals
    ranked = df.withColumn("_i", F.row_number().over(W.partitionBy(stratum).orderBy(*order)) - 1).join(F.broadcast(quota.drop("_n")), stratum)
    # row i is a pick if some whole j has floor(j * c / q) = i
    j = F.ceil(F.col("_i") * F.col("_q") / F.col("_c"))
    return ranked.where(F.floor(j * F.col("_c") / F.col("_q")) == F.col("_i")).where(j < F.col("_q")).drop("_i", "_c", "_q")
