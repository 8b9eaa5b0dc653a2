"""Near-duplicate documents by SimHash and a byte-position inverted index.

A 64-bit fingerprint has eight positional bytes. Two fingerprints that differ in at most four bits
differ in at most four bytes, so at least four of the eight positional bytes are equal. Of any four
positions, three lie in one of the 20 position triples below (a covering design), so postings keyed
by a triple's three bytes miss no link, and a posting list holds a 2^-24 share of unrelated
fingerprints. Within a list the shared positional bytes of each pair are tallied, pairs with fewer
than the guaranteed four fall out, and the rest are verified by their differing bits.

Only distinct fingerprints are indexed, so exact copies never meet. A list yields a spanning forest
of its links, not all pairs. A list above ``max_list`` fingerprints is not compared pair by pair: its
members are linked through the 2081 words within two bits of each (two fingerprints are within four
bits exactly if such balls meet), which grows with the list, not its square, and is exact too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, components, may_hold

MAX_BITS = 4
SPACES = bytes(range(9, 14)) + b" "


def _covering_triples() -> list[tuple[int, int, int]]:
    """20 triples of the 8 positions such that any 4 positions contain one.

    Positions in three cyclic classes; a triple is taken if it lies in one class or has two members
    in a class and one in the next (Turan's construction).
    """
    classes = [(0, 1, 2), (3, 4, 5), (6, 7)]
    where = {p: c for c, ps in enumerate(classes) for p in ps}
    found = []
    for t in combinations(range(8), 3):
        n = [sum(where[p] == c for p in t) for c in range(3)]
        if 3 in n or any(n[c] == 2 and n[(c + 1) % 3] == 1 for c in range(3)):
            found.append(t)
    return found


TRIPLES = _covering_triples()


def shingles(text: str | None, words: int) -> np.ndarray:
    """XXH64 with seed 42 of each word shingle, with repeats; A-Z is lower-cased. A shorter text is one shingle."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split(b" ")
    w = [x for x in w if x]
    if len(w) > words:
        spans = [w[i:] for i in range(words)]
        found = map(b" ".join, zip(*spans, strict=False))
    else:
        found = [b" ".join(w)] if w else []
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in found), dtype=np.uint64)


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of one text: lower-cased A-Z, word shingles with repeats, XXH64 with seed 42."""
    h = shingles(text, words)
    if not len(h):
        return 0
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65536):
        total += np.unpackbits(h[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(h)).tobytes(), "big")


_TO_SPACE = bytes(32 if c in SPACES else c for c in range(256))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp) for every row; fp is the fingerprint as a signed long. Null and empty texts give 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py(), words) for x in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of one posting list, by tallied bytes and verified bits."""
    v = np.unique(values.view(np.uint64))
    n = len(v)
    label, out = np.arange(n), []
    lanes = v.view(np.uint8).reshape(n, 8)
    for i in range(n - 1):
        shared = (lanes[i + 1 :] == lanes[i]).sum(axis=1)  # the tally of positional bytes
        js = np.flatnonzero(shared >= 8 - MAX_BITS) + i + 1
        js = js[np.bitwise_count(v[js] ^ v[i]) <= MAX_BITS]
        for j in js[label[js] != label[i]]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    signed = v.view(np.int64)
    return [(int(signed[i]), int(signed[j])) for i, j in out]


def links(fps: DataFrame, max_list: int = 2048) -> DataFrame:
    """Links (a, b) between distinct fingerprints in column fp that connect all within four bits.

    Every component of the graph of all such pairs is a component of the links returned.
    """
    distinct = fps.select("fp").distinct()
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = [
        F.lit(n << 24).cast("long") + F.shiftleft(byte(x), 16) + F.shiftleft(byte(y), 8) + byte(z)
        for n, (x, y, z) in enumerate(TRIPLES)
    ]
    index = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    size = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
    pair = size.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    some = index.join(size.where(f"n > 2 and n <= {max_list}").select("key"), "key").groupBy("key").agg(F.collect_list("fp").alias("fps"))

    def forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([x for v in b["fps"] for x in _forest(np.array(v, dtype=np.int64))], columns=["a", "b"], dtype="int64")

    few = some.select("fps").mapInPandas(forests, "a long, b long")
    large = index.join(size.where(f"n > {max_list}").select("key"), "key").select("fp").distinct()

    def balls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
        two = np.array([a | b for a, b in combinations(one, 2)], dtype=np.uint64)
        masks = np.concatenate([[np.uint64(0)], one, two]).astype(np.uint64)
        for b in batches:
            fp = b["fp"].to_numpy().view(np.uint64)
            for i in range(0, len(fp), 256):
                part = fp[i : i + 256]
                near = (part[:, None] ^ masks[None, :]).ravel()
                yield pd.DataFrame({"z": near.view(np.int64), "fp": np.repeat(part, len(masks)).view(np.int64)})

    ball = large.mapInPandas(balls, "z long, fp long")
    centre = ball.groupBy("z").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a <> top").select("z", "a")
    dense = ball.join(centre, "z").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    return pair.unionByName(few).unionByName(dense)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_list: int = 2048) -> DataFrame:
    """One row per row of ``docs``: id, fp (signed long) and component_id, the smallest id reachable.

    Texts link at four or fewer differing fingerprint bits. Null, empty and blank texts have
    fingerprint zero and link like any other. Repeated ids each keep their row; a null id stays null
    and takes the component of its fingerprint. An empty table gives an empty result; other columns
    of ``docs`` are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fp = scratch.save(fingerprints(docs, id_col, text_col, words), "fps")
    groups = fp.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(links(fp, max_list), scratch)
    rooted = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(lowest, "root").select("fp", "component_id")
    return fp.join(of, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_list: int = 2048) -> DataFrame:
    """The documents with the smallest id of each component; all columns as they were.

    A row with a null id has no place in the order and stays. Rows repeated under one id stay together.
    """
    found = near_duplicates(docs.select(id_col, text_col), id_col, text_col, words, max_list)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")


# Near copies by a similarity of shingle sets. At a Jaccard index of 0.8 SimHashes of whole texts differ in
# about ten of 64 bits, so no eight positional bytes can be equal with certainty. The wide fingerprint is
# MinHash: it has POSITIONS positions of eight bytes, each the one shingle that is least under the position's
# own hash, so that it is equal with the probability of the Jaccard index; index, tally and verification are
# as above.
POSITIONS, LEAST_SHARED = 16, 5  # at 0.8 fewer than five of sixteen are shared once in four million pairs
FEW = 16  # sets of a list, or groups of a longer one by one set each, that are compared with each other at once
BLOCK = 512  # sets of a list whose pairs with another such block are made in one place


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """The positional values of a set of shingle digests; of an empty set the positions' numbers."""
    out = np.arange(POSITIONS, dtype=np.uint64)
    if len(h):
        for p in range(POSITIONS):
            x = (h ^ np.uint64(0x9E3779B97F4A7C15 * (p + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            out[p] = (x ^ (x >> np.uint64(29))).min()  # of a bijection of the digests, so it names the shingle
    return out


def _members(docs: DataFrame, words: int) -> DataFrame:
    """(id, text_key, sid, n, values) of every row: its text's digest, its set's digest and size, the wide fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            sets = [np.unique(shingles(x.as_py(), words)) for x in b.column(2)]
            sid = pa.array([xxhash.xxh128_hexdigest(s.tobytes()) for s in sets], pa.string())
            values = pa.array([wide_fingerprint(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sid, pa.array([len(s) for s in sets], pa.int64()), values], names=["id", "text_key", "sid", "n", "values"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, f"id {kind}, text_key long, sid string, n long, values array<bigint>")


def _pairs(held: DataFrame, fits) -> DataFrame:
    """(p, q, x, y): the sets of each list with each other, where labels and sizes allow a link."""
    a, b = held.select("key", F.col("sid").alias("p"), F.col("label").alias("x"), F.col("n").alias("m")), held.select("key", F.col("sid").alias("q"), F.col("label").alias("y"), "n")
    return a.join(b, "key").where((F.col("p") < F.col("q")) & fits).select("p", "q", "x", "y")


def _all_pairs(held: DataFrame, fits, block: int = BLOCK) -> DataFrame:
    """(p, q, x, y): as ``_pairs`` for lists of any length, cut into blocks of about ``block`` sets that meet one by one.

    Pairs of two sets of a list's most frequent label are not made, so a large group costs no square.
    """
    size = held.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.sum("c").alias("c"), F.max_by("label", F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("labels"))
    cut = held.join(size.where("labels > 1").withColumn("parts", F.ceil(F.col("c") / block).cast("int")).drop("c", "labels"), "key")
    cut = cut.withColumns({"part": F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"), "parts": F.sequence(F.lit(0), F.col("parts") - 1)})
    a = cut.where("label <> top").select("key", "part", F.explode("parts").alias("other"), F.col("sid").alias("p"), F.col("label").alias("x"), F.col("n").alias("m"))
    b = cut.select("key", F.explode("parts").alias("part"), F.col("part").alias("other"), F.col("sid").alias("q"), F.col("label").alias("y"), "n", (F.col("label") == F.col("top")).alias("common"))
    return a.join(b, ["key", "part", "other"]).where((F.col("common") | (F.col("p") < F.col("q"))) & fits).select("p", "q", "x", "y")


def _hubs(held: DataFrame, fits) -> DataFrame:
    """(p, q, x, y): each set with the hub, of those of its lists, that it shares most lists with, where labels and sizes allow a link."""
    hub = held.groupBy("key").agg(F.min_by("sid", "at").alias("p"), F.min_by("label", "at").alias("x"), F.min_by("n", "at").alias("m"))
    spokes = held.select("key", F.col("sid").alias("q"), F.col("label").alias("y"), "n").join(hub, "key").where(fits)
    shared = spokes.groupBy("q", "p", "x", "y").agg(F.count(F.lit(1)).alias("c"))
    return shared.groupBy("q").agg(F.max(F.struct("c", "p", "x", "y")).alias("b")).select(F.col("b.p").alias("p"), "q", F.col("b.x").alias("x"), F.col("b.y").alias("y"))


def _by_shingles(rows: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(key, sid, label, n): lists of sets by their rarest shingles; two sets of ``similarity`` share a list with certainty (prefix filter)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingles(x.as_py(), words)).view(np.int64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["sid", "keys"])

    kept = rows.select("sid", "label", "n", "text_key")
    held = kept.join(texts, "text_key").select("sid", "text").mapInArrow(run, "sid string, keys array<bigint>").select("sid", F.explode("keys").alias("key"))
    often = held.groupBy("key").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    ranked = held.join(often, "key").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("f", "key"))).alias("o")).join(kept.drop("text_key"), "sid")
    length = F.size("o") - F.ceil(F.col("n") * similarity - 1e-9).cast("int") + 1  # shingles of one set only come first and link nothing
    return ranked.where(length > 0).select(F.explode(F.slice("o", F.lit(1), length)).alias("s"), "sid", "label", "n").select("s.key", "sid", "label", "n")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: id and component_id, the smallest id reachable.

    Texts link if the Jaccard index of their sets of ``words``-word shingles is ``similarity`` or more;
    texts of fewer words are one shingle, and those without words have the empty set and link with each
    other. Pairs share LEAST_SHARED positions, by tally, and are verified on their whole texts: each set
    with one hub of its lists; then in lists of at most FEW sets all that are in different groups, in longer
    lists one set of each group with all others, or with the hub if they are more than FEW. That leaves few
    groups; where a longer list still has several, as with documents of one template, all of its sets get
    further lists, by their rarest shingles, and there each meets all sets of other groups, however long
    the list is. Repeated ids each keep their row; a null id stays null; an empty table gives an empty
    result; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "similar")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    members = scratch.save(_members(docs, words), "members")
    sets = members.groupBy("sid").agg(F.min("n").alias("n"), F.min("text_key").alias("text_key"), F.min("values").alias("values"))
    index = sets.select("sid", "n", F.posexplode("values").alias("at", "v")).select("sid", "n", F.xxhash64("at", "v").alias("key"))
    shared = index.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    lists = scratch.save(index.join(shared, "key"), "lists")
    some = scratch.save(sets.join(lists.select("sid").distinct(), "sid"), "sets")
    keys = some.select("text_key").distinct()
    texts = scratch.save(may_hold(docs.select(F.xxhash64("text").alias("text_key"), "text"), "text_key", keys).join(keys, "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text")), "texts")
    fits = (F.col("x") != F.col("y")) & (F.least("m", "n") >= F.greatest("m", "n") * similarity - 1e-9)

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for s, t in zip(b["s"], b["t"], strict=True):
                one, two = np.unique(shingles(s, words)), np.unique(shingles(t, words))
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(common >= similarity * (len(one) + len(two) - common) - 1e-9)
            yield b.loc[np.array(keep, dtype=bool), ["x", "y"]]

    def relabel(labels: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        side = lambda sid, k, v: some.select(F.col("sid").alias(sid), F.col("text_key").alias(k), F.col("values").alias(v))
        tallied = pairs.join(side("p", "j", "a"), "p").join(side("q", "k", "b"), "q").where(F.size(F.filter(F.zip_with("a", "b", lambda a, b: a == b), lambda e: e)) >= LEAST_SHARED)
        both = tallied.select("j", "k", "x", "y").join(texts.select(F.col("text_key").alias("j"), F.col("text").alias("s")), "j").join(texts.select(F.col("text_key").alias("k"), F.col("text").alias("t")), "k")
        edges = both.select("x", "y", "s", "t").mapInPandas(verified, "x string, y string")
        with Scratch(spark, "similar") as own:
            roots = components(edges, own).withColumnRenamed("node", "label")
            return scratch.save(labels.join(roots, "label", "left").select("sid", F.coalesce("root", "label").alias("label")), name)

    labels = some.select("sid", F.col("sid").alias("label"))
    labels = relabel(labels, _hubs(lists.join(labels, "sid").withColumn("at", F.xxhash64("sid", F.lit(0))), fits), "labels0")
    held = lists.join(labels, "sid").withColumn("at", F.xxhash64("sid", F.lit(1)))
    size = held.groupBy("key").agg(F.count(F.lit(1)).alias("sets"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key", "sets")
    mixed = held.join(size, "key")
    each = mixed.where(F.col("sets") > FEW).groupBy("key", "label").agg(F.min_by("sid", "at").alias("sid"), F.min_by("n", "at").alias("n"), F.min("at").alias("at"))
    each = each.join(each.groupBy("key").agg(F.count(F.lit(1)).alias("groups")), "key")
    whole = mixed.where(F.col("sets") <= FEW).select("key", "label", "sid", "n", "at", F.lit(0).cast("long").alias("groups"))
    rest = scratch.save(whole.unionByName(each.select("key", "label", "sid", "n", "at", "groups")), "rest")
    pairs = _pairs(rest.where(F.col("groups") <= FEW), fits).unionByName(_hubs(rest.where(F.col("groups") > FEW), fits))
    labels = relabel(labels, pairs.distinct(), "labels1")
    # what is left: sets of longer lists that hold several groups still, each with all of the other groups
    held = lists.join(size.where(F.col("sets") > FEW), "key").join(labels, "sid")
    mixed = held.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    left = scratch.save(held.join(mixed, "key", "left_semi").select("sid", "label", "n").distinct().join(some.select("sid", "text_key"), "sid"), "left")
    if not left.isEmpty():
        further = scratch.save(_by_shingles(left, texts, words, similarity), "further")
        labels = relabel(labels, _all_pairs(further, fits).distinct(), "labels")
    rooted = members.join(labels, "sid", "left").select("id", F.coalesce("label", "sid").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    scratch.drop("lists", "sets", "texts", "rest", "left", "further", "labels0")
    return rooted.join(lowest, "root").select(F.col("id").alias(id_col), "component_id")


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents with the smallest id of each component of ``similar_documents``; all columns as they were.

    A row with a null id has no place in the order and stays. Rows repeated under one id stay together.
    """
    found = similar_documents(docs, id_col, text_col, words, similarity)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")
