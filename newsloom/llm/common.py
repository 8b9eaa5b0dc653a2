"""What the operators of this subpackage share: reading tables, cutting lineage, splitting by hash."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m: the fold a row belongs to."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(m))


def send(spark: SparkSession, thing: object) -> Callable[[], object]:
    """A function that gives ``thing`` in tasks: broadcast once, unpickled once per worker. Its size must be bounded."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    key = uuid.uuid4().hex

    def get() -> object:
        import pickle
        import sys

        held = sys.__dict__.setdefault("_newsloom_sent", {})
        if key not in held:
            if len(held) > 3:
                held.clear()
            held[key] = pickle.loads(packed.value)
        return held[key]

    return get


class Scratch:
    """Tables in the shared folder that spark.checkpoint.dir names, for results that more than one job reads.

    A table written here survives the loss of any executor, unlike cached or shuffled blocks, and
    cuts the lineage of iterative work. Where the setting is missing a local session (tests) gets a
    folder of its own, and any other raises. As a context manager it drops all of its tables at the
    end; the tables behind a result that is returned stay, and ``drop`` removes those no longer read.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="newsloom-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self._delete(self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 200) -> DataFrame:
    """Connected components of an undirected graph, as (node, root) with root the smallest node.

    ``edges`` has two columns of one orderable type; loops and repeats do no harm; rows with a
    null end are left out. Only nodes with an edge are returned. Alternating large-star and
    small-star steps: each is an aggregation with map-side combining and an equi-join that adaptive
    execution can split, so a node with very many neighbours never has to fit one task. Each round
    is written to the scratch folder; the driver sees a count and a checksum per round. The rounds
    grow with the logarithm of the longest path; a graph not done after ``max_rounds`` raises.
    """
    a, b = edges.columns
    links = scratch.save(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct(), "links0"
    )

    def stars(pairs: DataFrame, keep: str) -> DataFrame:
        """Every node's smallest neighbour (itself included), linked with its neighbours that pass ``keep``."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(least, "u").where(keep).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v")

    def done(pairs: DataFrame) -> bool:
        """Whether each node that has a smaller neighbour has one only, and that one has none."""
        many = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
        chained = pairs.join(pairs.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u")
        return many.unionByName(chained).isEmpty()

    for i in range(1, max_rounds + 1):
        if done(links):
            roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stars(both, "v > u").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("x"), "m"), F.struct(F.col("u").alias("x"), "m"))).alias("s"))
        small = small.select(F.col("s.x").alias("u"), F.col("s.m").alias("v")).where("u <> v").distinct()
        links = scratch.save(small, f"links{i}")
        scratch.drop(f"links{i - 1}")
    raise RuntimeError(f"components not found in {max_rounds} rounds")


def may_hold(rows: DataFrame, key: str, wanted: DataFrame, bits: int = 26) -> DataFrame:
    """The rows whose long ``key`` may be among ``wanted`` (one column of that name): none of those is lost.

    A bitmap of 2^bits hashed keys, 8 MB by default at any size of ``wanted``, is broadcast in pieces of
    64 bytes, so most other rows fall out before a shuffle and none copies more than its piece. The
    exact join has to follow.
    """
    slot = F.coalesce(F.pmod(F.xxhash64(key), F.lit(1 << bits)), F.lit(0).cast("long"))  # never null, so no filter for nulls makes the key anew
    # the bitmap functions count from 1: value v > 0 is bit (v - 1) % 32768 of map (v - 1) div 32768 + 1
    maps = wanted.select((slot + 1).alias("_slot")).groupBy(F.bitmap_bucket_number("_slot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_map"))
    pieces = maps.select(F.col("_bucket"), "_map", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_i"))
    pieces = pieces.select(((F.col("_bucket") - 1) * 64 + F.col("_i")).alias("_piece"), F.expr("substring(_map, _i * 64 + 1, 64)").alias("_map")).where(F.col("_map") != F.lit(bytes(64)))
    byte = F.conv(F.hex(F.expr("substring(_map, cast(_at div 8 AS int) + 1, 1)")), 16, 10).cast("int")
    held = rows.withColumn("_slot", slot).withColumns({"_piece": F.shiftright("_slot", 9), "_at": F.col("_slot").bitwiseAND(511)}).join(F.broadcast(pieces), "_piece")
    return held.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 AS int))")) != 0).select(*rows.columns)
