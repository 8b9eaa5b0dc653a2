"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are dealt into blocks. A source of weight w gives its j-th block the release
time floor((j-1)/w) and the deadline ceil(j/w); each slot takes the released block with the earliest
deadline. On one channel this keeps every source within one block of weight x slots at every slot.
Weights are whole parts, so the schedule repeats after their sum q: one period of it fixes the slot
of every block by arithmetic on the block's number. Where a source runs out, a new phase starts with
the sources that are left, so every document is placed once.

The driver computes the periods from one count per source; documents stay in DataFrame operations.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def period(parts: list[int]) -> list[int]:
    """Earliest deadline first over one period: the source that each of sum(parts) slots serves."""
    q, served, slots = sum(parts), [0] * len(parts), []
    for t in range(q):
        due = [(-(-(served[i] + 1) * q // p), i) for i, p in enumerate(parts) if p and served[i] * q < (t + 1) * p]
        i = min(due)[1]
        served[i] += 1
        slots.append(i)
    return slots


def phases(blocks: list[int], parts: list[int]) -> list[dict]:
    """The schedule until every source has run out; a row for each phase and each source still in it.

    i: source; first_slot, q: the phase's first slot and period; part: blocks in a period; base,
    n: the source's blocks before and in the phase; at: the slots of its blocks within a period.
    """
    left, done, first, rows = list(blocks), [0] * len(blocks), 0, []
    while any(left):
        p = [w if n else 0 for w, n in zip(parts, left, strict=True)]
        slots, q = period(p), sum(p)
        at = [[t for t, k in enumerate(slots) if k == i] for i in range(len(p))]
        ends = [(n - 1) // w * q + at[i][(n - 1) % w] + 1 for i, (n, w) in enumerate(zip(left, p, strict=True)) if n]
        length = min(ends)
        for i, w in enumerate(p):
            if w:
                n = length // q * w + sum(t < length % q for t in at[i])
                rows.append({"i": i, "first_slot": first, "q": q, "part": w, "base": done[i], "n": n, "at": at[i]})
                left[i] -= n
                done[i] += n
        first += length
    return rows


def tempered(counts: dict[str, int], exponent: float = 0.5, resolution: int = 360) -> dict[str, int]:
    """Whole parts in proportion to count ** exponent, about ``resolution`` in all, one at least."""
    total = sum(c**exponent for c in counts.values()) or 1.0
    return {k: max(1, round(resolution * c**exponent / total)) for k, c in counts.items()}


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", weights: dict[str | None, int] | None = None, block_rows: int = 64, max_sources: int = 1000) -> DataFrame:
    """All rows of ``docs`` with mix_block, mix_slot and mix_place.

    mix_block is the number of the row's block within its source, mix_slot the slot of that block in
    the interleaved order, mix_place the row's place in its block; reading by (mix_slot, mix_place)
    gives the mixture. Within a source the order is that of md5(id), ties by the whole row's hash.

    ``weights`` gives whole positive parts by source (a source without one gets 1); by default they
    are tempered counts. A null source is a source of its own (key None). Empty tables give empty
    results; null ids and repeated rows are placed like any other row; a column named like one of the
    three is replaced. More than ``max_sources`` sources raise ValueError: the plan's size, which is
    broadcast, is bounded by their number, not by the documents.
    """
    spark = docs.sparkSession
    docs = docs.drop("mix_block", "mix_slot", "mix_place")
    ordered = docs.select("*", F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("_mix_h"), F.xxhash64(*docs.columns).alias("_mix_x"), F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("_mix_s"))
    counts = {r[0]: r[1] for r in ordered.groupBy("_mix_s").agg(F.count(F.lit(1)).alias("n")).orderBy("_mix_s").limit(max_sources + 1).collect()}
    if len(counts) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    names = sorted(counts)
    parts = tempered(counts) if weights is None else {("n" if k is None else f"s{k}"): int(v) for k, v in weights.items()}
    if any(v < 1 for v in parts.values()):
        raise ValueError("weights are whole positive parts")
    plan = phases([-(-counts[k] // block_rows) for k in names], [parts.get(k, 1) for k in names])
    plan = [{"_mix_s": names[r.pop("i")], **r} for r in plan]
    schema = "array<struct<_mix_s:string,first_slot:bigint,q:bigint,part:bigint,base:bigint,n:bigint,at:array<bigint>>>"
    plan_df = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(plan)), schema)))

    # ranks within a source: hash prefixes of about a thousand rows, their counts summed up, then a rank in each
    digits, rows = 1, sum(counts.values())
    while 16**digits * 2000 < rows:
        digits += 1
    cut = ordered.withColumn("_mix_b", F.substring("_mix_h", 1, digits))
    before = cut.groupBy("_mix_s", "_mix_b").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("_mix_s", "_mix_b", (F.sum("n").over(W.partitionBy("_mix_s").orderBy("_mix_b")) - F.col("n")).alias("_mix_0"))
    inside = F.row_number().over(W.partitionBy("_mix_s", "_mix_b").orderBy("_mix_h", "_mix_x"))
    ranked = cut.withColumn("_mix_r", inside).join(before, ["_mix_s", "_mix_b"]).withColumn("_mix_r", F.col("_mix_0") + F.col("_mix_r") - 1)
    ranked = ranked.withColumn("mix_block", F.expr(f"_mix_r div {block_rows}")).withColumn("mix_place", (F.col("_mix_r") % block_rows).cast("int"))
    d, p = ranked.alias("d"), F.broadcast(plan_df).alias("p")
    placed = d.join(p, F.expr("d._mix_s = p._mix_s AND d.mix_block >= p.base AND d.mix_block < p.base + p.n"))
    slot = F.expr("p.first_slot + (d.mix_block - p.base) div p.part * p.q + p.at[cast((d.mix_block - p.base) % p.part AS int)]")
    return placed.select(*(F.col(f"d.`{c}`") for c in docs.columns), F.col("d.mix_block"), slot.alias("mix_slot"), F.col("d.mix_place"))


def order(placed: DataFrame, partitions: int | None = None) -> DataFrame:
    """The mixture in reading order: range-partitioned by slot and sorted within partitions."""
    keys = ["mix_slot", "mix_place"]
    dealt = placed.repartitionByRange(partitions, *keys) if partitions else placed.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys)
