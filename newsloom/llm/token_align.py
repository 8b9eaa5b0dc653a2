"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

The alignment is relational: tokens are posexploded, windowed cumulative byte lengths give their ends,
an equi-join on (sequence, end) finds the offsets where tokens of both sides end, running counts of
these cuts number the groups, and the join's rows are the links, counted by pair of ids.

Words repeat, and both tokenizers cut at certain places whatever stands around them: between a letter
and an ASCII sign, between a sign or digit and a space, around a single line end. The sequences that
are tokenised and aligned are therefore the distinct pieces between such places, weighted by their
counts; a text is the chain of its pieces. A piece's groups, links and ids are those of any text around
it, so sums over pieces are exact. Where a vocabulary can't promise these cuts, whole texts are the
pieces.

Texts get their pieces' results back in two ways: the most frequent pieces, at most ``FREQUENT`` of at
most ``FREQUENT_BYTES`` bytes, are broadcast; all others are joined by a shuffle. The counts of linked
pairs are broadcast as well: of linked tokens one is a suffix of the other, so there are never more
pairs than the vocabularies have such suffixes (``pair_bound``).
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, send

FREQUENT = 250_000
FREQUENT_BYTES = 48
STEP = 1 << 22  # bytes of text that a task cuts at a time
_SPACE = "▁"
# Letters and signs that every version of Unicode classes alike: ASCII, U+00C0 to U+017F, and Cyrillic.
_LETTER, _SIGN = "A-Za-zÀ-ÖØ-öø-ſЀ-џ", r"!-/:-@\[-`{-~"
_UNSURE = re.compile(rf"[{_LETTER}][\x00-/:-@\[-`{{-\x7f{_SPACE}]|[{_SIGN}0-9]{_SPACE}|\n")
_HELD = "_newsloom_tokenizers"  # where a worker keeps them between tasks: functions come with their modules each time


class Tokenizers:
    """Both tokenizers, each token's bytes, and whether the places of ``_CUTS`` are sure cuts of both."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        byte = _byte_of_char()
        entries = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [bytes(byte[c] for c in entries[i]) if i in entries else b"" for i in range(max(entries) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        probe = " a  ﬁ Å ① x "
        plain = self.b.normalize(probe) == _SPACE + probe.replace(" ", _SPACE)
        splits = self.a.normalizer is None and str(self.a.pre_tokenizer).startswith("ByteLevel") and "use_regex=True" in str(self.a.pre_tokenizer)
        normal = (p for i, p in enumerate(pieces) if self.b_bytes[i] and not self.b.is_byte(i))
        self.sure = plain and splits and not any(_UNSURE.search(p) for p in normal)

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        """The tokenizer adds a space of its own: a leading one is left to it; other pieces, and a lone space, are put behind a line end, whose two tokens are dropped."""
        own = [t[:1] == " " and (len(t) > 1 or not self.sure) for t in texts]
        found = self.b.encode([t[1:] if o else "\n" + t for t, o in zip(texts, own, strict=True)], num_threads=1)
        return [ids if o else ids[2:] for o, ids in zip(own, found, strict=True)]


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write a byte as itself where it is a visible Latin-1 character, the others from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """Loaded once for each worker."""
    held = sys.__dict__.setdefault(_HELD, {})
    if (a_path, b_path) not in held:
        held.clear()
        held[a_path, b_path] = Tokenizers(a_path, b_path)
    return held[a_path, b_path]


def _let_go() -> None:
    """Frees a worker's tokenizers where no more is tokenised."""
    sys.__dict__.pop(_HELD, None)


def pair_bound(t: Tokenizers) -> int:
    """How many pairs of ids can ever be linked: those of which one token's bytes end with the other's."""
    from collections import Counter

    a, b = Counter(x for x in t.a_bytes if x), Counter(x for x in t.b_bytes if x)
    longer = lambda x, y: sum(n * y[k[i:]] for k, n in x.items() for i in range(1, len(k)))
    return longer(a, b) + longer(b, a) + sum(n * b[k] for k, n in a.items())


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By a byte and the one before it, whether it ends a letter; by byte, whether it is an ASCII sign or digit, and whether a letter or sign may start with it."""
    byte = np.arange(256)
    ascii_letter = ((byte | 32) >= 97) & ((byte | 32) <= 122) & (byte < 128)
    sign = (byte > 32) & (byte < 127) & ~ascii_letter
    letter = np.zeros((256, 256), dtype=bool)
    letter[:, ascii_letter] = True
    letter[0xC3:0xC6, 0x80:0xC0] = letter[0xD0, 0x80:0xC0] = letter[0xD1, 0x80:0xA0] = True
    letter[0xC3, [0x97, 0xB7]] = False  # the signs of multiplication and division
    return letter.ravel(), sign, ascii_letter | sign | np.isin(byte, [0xC3, 0xC4, 0xC5, 0xD0])


_ENDS_LETTER, _IS_SIGN, _STARTS = _classes()
_OTHER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def cut(texts: pa.Array, sure: bool) -> tuple[pa.Array, np.ndarray]:
    """(pieces, at): a space and each text, cut where both tokenizers surely cut; text i has the pieces from at[i] to at[i + 1].

    Texts that are null or empty, or hold the sign that stands for a space, have no pieces.
    """
    texts = texts.cast(pa.string())
    able = pc.fill_null(pc.and_(pc.not_equal(texts, ""), pc.invert(pc.match_substring(texts, _SPACE))), False)
    one = lambda x: pa.scalar(x, pa.string())
    spaced = pc.if_else(able, pc.binary_join_element_wise(one(" "), pc.fill_null(texts, ""), one("")), one(""))
    ends = np.frombuffer(spaced.buffers()[1], dtype=np.int32)[spaced.offset : spaced.offset + len(spaced) + 1]
    data = spaced.buffers()[2]
    first, last = (int(ends[0]), int(ends[-1])) if len(spaced) else (0, 0)
    b = np.frombuffer(data, dtype=np.uint8)[first:last] if last > first else np.zeros(0, dtype=np.uint8)
    starts = np.zeros(len(b) + 1, dtype=bool)
    if sure and len(b) > 2:
        letter = np.zeros(len(b), dtype=bool)
        letter[1:] = _ENDS_LETTER[(b[:-1].astype(np.uint16) << 8) | b[1:]]
        sign, line = _IS_SIGN[b], b == 10
        starts[1:-1] = (letter[:-1] & _OTHER[b[1:]]) | (sign[:-1] & (line[1:] | (b[1:] == 32)))
        starts[2:-1] |= line[1:-1] & (letter | sign)[:-2] & _STARTS[b[2:]]
    starts[ends - first] = True
    offsets = np.flatnonzero(starts).astype(np.int32) + first
    found = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), data) if len(b) else pa.array([], pa.string())
    return found, np.searchsorted(offsets, ends)


def _tokenise(a_path: str, b_path: str):
    def columns(found: list[list[int]], lens: np.ndarray) -> list[pa.Array]:
        ids = np.fromiter((i for x in found for i in x), dtype=np.int32)
        at = pa.array(np.cumsum([0, *map(len, found)], dtype=np.int32))
        return [pa.ListArray.from_arrays(at, pa.array(ids)), pa.ListArray.from_arrays(at, pa.array(lens[ids]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(a_path, b_path)
        len_a, len_b = (np.array([len(x) for x in xs], dtype=np.int32) for xs in (t.a_bytes, t.b_bytes))
        for b in batches:
            texts = b.column("piece").to_pylist()
            a_ids, b_ids = t.encode_a(texts), t.encode_b(texts)
            ok = [b"".join(map(t.a_bytes.__getitem__, x)) == (raw := s.encode()) and b"".join(map(t.b_bytes.__getitem__, y)) == raw for s, x, y in zip(texts, a_ids, b_ids, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("piece"), b.column("n"), pa.array(ok), *columns(a_ids, len_a), *columns(b_ids, len_b)], ["piece", "n", "ok", "a", "a_len", "b", "b_len"])

    return run


def ends(sequences: DataFrame, sides: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(key, n, side, pos, id, end, piece) of each token: its side (0 for a, 1 for b), place, id and the bytes up to its end; the piece is with its first token only.

    Tokens stay in the partition of their sequence, so no later step on (key, ...) has to shuffle them.
    """
    sided = lambda side, s: F.zip_with(s, f"{s}_len", lambda i, n: F.struct(F.lit(side).alias("side"), i.alias("id"), n.alias("len")))
    tokens = sequences.select("key", "piece", "n", F.posexplode(F.concat(*(sided(i, "ab"[i]) for i in sides))).alias("pos", "t"))
    end = F.sum("t.len").over(W.partitionBy("key", "t.side").orderBy("pos"))
    return tokens.select("key", "n", F.col("t.side").alias("side"), "pos", F.col("t.id").alias("id"), end.alias("end"), F.when(F.col("pos") == 0, F.col("piece")).alias("piece"))


def links(sequences: DataFrame) -> DataFrame:
    """(key, end, n, a, b): tokens of both sides that end together, for sequences (key, piece, n, a, a_len, b, b_len): ids, and their lengths in bytes."""
    a = ends(sequences, (0,)).select("key", "end", "n", F.col("id").alias("a"))
    return a.join(ends(sequences, (1,)).select("key", "end", F.col("id").alias("b")), ["key", "end"])


def groups(sequences: DataFrame, counted: DataFrame) -> DataFrame:
    """(piece, n, numbers, groups) of each sequence: its groups between the cuts, in order, as 'a1,a2|b1;a3|b2,b3', and sums over its links (key, end, count, best)."""
    marked = ends(sequences).join(counted, ["key", "end"], "left")
    before = W.partitionBy("key", "side").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    of = lambda side, x: F.when(F.col("side") == side, x)
    link = of(0, F.col("count"))
    # Each token is written with what follows it, so a sequence's groups are its tokens by group, side and place.
    behind = F.when(F.col("count").isNull(), ",").when(F.col("side") == 0, "|").otherwise(";")
    token = F.struct(F.count("count").over(before).alias("group"), "side", "pos", F.concat(F.col("id").cast("string"), behind).alias("s"))
    each = marked.select("key", "n", "piece", "side", "count", "best", token.alias("token")).groupBy("key").agg(
        F.max("piece").alias("piece"), F.max("n").alias("n"), F.count(of(0, F.lit(1))).alias("n_a"), F.count(of(1, F.lit(1))).alias("n_b"), F.count(link).alias("n_links"),
        F.count(F.when(link.isNotNull() & F.col("best"), 1)).alias("n_best"), F.sum(link).alias("count_sum"), F.sort_array(F.collect_list("token")).alias("tokens"),
    )
    text = F.rtrim(F.array_join(F.col("tokens").getField("s"), ""), F.lit(";"))
    return each.select("piece", "n", *(F.col(c).cast("int").alias(c) for c in _NUMBERS[:-1]), "count_sum", text.alias("groups"))


_NUMBERS = ("n_a", "n_b", "n_links", "n_best", "count_sum")  # a text has as many groups as links


def _by_key(spark: SparkSession) -> SparkSession:
    """A session like this one whose joins on (key, end) take rows that are dealt by key as they are."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return own


def align_pieces(spark: SparkSession, path: str, pairs_at_most: int) -> DataFrame:
    """Each piece's numbers and groups, from the table at ``path``: key, piece, n (how often the piece stands in the corpus), a, a_len, b, b_len."""
    own = Scratch(spark, "token-align-pieces")
    own.spark = _by_key(spark)
    dealt = own.spark.read.parquet(path).repartition("key")
    found = own.save(links(dealt), "links")
    pairs = own.save(found.groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    if pairs.count() > pairs_at_most:
        raise ValueError("more linked pairs than the vocabularies allow")
    best = pairs.withColumn("best", F.col("count") == F.max("count").over(W.partitionBy("b")))
    counted = found.join(F.broadcast(best), ["a", "b"]).select("key", "end", "count", "best").repartition("key")
    aligned = own.save(groups(dealt, counted), "aligned")
    own.drop("links", "pairs")
    return spark.read.schema(aligned.schema).parquet(f"{own.root}/aligned")


def _frequent(aligned: DataFrame, most: int) -> tuple[DataFrame, int]:
    """(The short pieces that occur at least some number of times, that number), the least number that keeps them below ``most``."""
    short = aligned.where(F.octet_length("piece") <= FREQUENT_BYTES)
    # A row for each number of occurrences, ever fewer as the numbers grow: the k-th greatest is at most the corpus over k.
    by_n = short.groupBy("n").count().orderBy(F.col("n").desc()).limit(most).collect()
    total, least = 0, None
    for r in by_n:
        total += r["count"]
        if total > most:
            break
        least = r["n"]
    return (short.where(F.col("n") >= least), least) if least else (short.limit(0), 0)


def _flat(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    lens = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.concatenate([[0], np.cumsum(lens)])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``STEP`` bytes of text, of one row at least."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
        at, i = np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + STEP, side="right")) - 1)
            yield b.slice(i, j - i)
            i = j


def _count(sure: bool):
    """Arrow batches of texts to (piece, n), each piece once a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            found = pc.value_counts(cut(b.column("text"), sure)[0])
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["piece", "n"])

    return run


def _places(get, sure: bool):
    """Arrow batches of (id, h, text) to (id, h, pos, piece): the pieces that are not known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _let_go()
        known = get()[0]
        for b in _slices(batches):
            flat, at = cut(b.column("text"), sure)
            new = np.flatnonzero(pc.is_null(pc.index_in(flat, value_set=known)).to_numpy(zero_copy_only=False))
            row = np.searchsorted(at, new, side="right") - 1
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), b.column("h").take(pa.array(row)), pa.array((new - at[row]).astype(np.int32)), flat.take(pa.array(new))], ["id", "h", "pos", "piece"])

    return run


def _assemble(get, sure: bool):
    """Arrow batches of (id, text, rare) to sums over the pieces and the digest of their groups; ``rare`` has what is not broadcast."""

    def some(known, numbers, written, b: pa.RecordBatch) -> pa.RecordBatch:
        flat, at = cut(b.column("text"), sure)
        rare, of = _flat(b.column("rare"))
        which = pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(rare):
            row = np.repeat(np.arange(b.num_rows), np.diff(of))
            which[at[row] + rare.field("pos").to_numpy(zero_copy_only=False)] = len(known) + np.arange(len(rare))
            numbers = [np.concatenate([x, rare.field(c).to_numpy(zero_copy_only=False).astype(np.int64)]) for c, x in zip(_NUMBERS, numbers, strict=True)]
            written = pa.concat_arrays([written, pc.binary_join_element_wise(rare.field("groups").cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(";", pa.large_string())).cast(pa.large_binary())])
        if len(which) and which.min() < 0:
            raise ValueError("a piece without an alignment")
        sums = [np.concatenate([[0], np.cumsum(x[which])]) for x in numbers]
        text = written.take(pa.array(which))
        byte, data = np.frombuffer(text.buffers()[1], dtype=np.int64)[: len(text) + 1], memoryview(text.buffers()[2] or b"")
        digests = [hashlib.sha256(data[byte[s] : byte[e] - 1]).hexdigest() if s < e else "" for s, e in zip(at, at[1:], strict=False)]
        return pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(x[at[1:]] - x[at[:-1]]) for x in sums), pa.array(digests, pa.string())], ["id", *_NUMBERS, "groups_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _let_go()
        known, numbers, written = get()
        for b in _slices(batches):
            yield some(known, numbers, written, b)

    return run


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of ``docs``.

    A text that is null or empty, or that either tokenizer doesn't give back byte for byte, has no
    tokens: zeros, and '' for the digest; it counts in no pair. Rows that repeat an id, or an id and
    text, each count and have a row; a null id is an id. Other columns are not read.
    """
    spark, t = docs.sparkSession, tokenizers(a_path, b_path)
    scratch, sure = Scratch(spark, "token-align"), t.sure
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    place, whole = f"id {docs.schema[id_col].dataType.simpleString()}, h long, pos int, piece string", lambda df, x: df["id"].eqNullSafe(x[f"{x.columns[0]}"]) & (df["h"] == x[f"{x.columns[1]}"])
    for attempt in ("tokens", "tokens-again"):
        counts = named.select("text").mapInArrow(_count(sure), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
        tokens = counts.mapInArrow(_tokenise(a_path, b_path), "piece string, n long, ok boolean, a array<int>, a_len array<int>, b array<int>, b_len array<int>")
        sequences = scratch.save(tokens.withColumn("key", F.monotonically_increasing_id()), attempt)
        broken = sequences.where("NOT ok").select("piece")
        if broken.isEmpty():
            break
        # Texts with a piece that a tokenizer doesn't give back have no tokens: they are told and counted no more.
        nothing = send(spark, (pa.array([], pa.string()),))
        lost = named.mapInArrow(_places(nothing, sure), place).join(broken, "piece", "left_semi").select(F.col("id").alias("lost_id"), F.col("h").alias("lost_h")).distinct()
        lost = scratch.save(lost, "lost")
        named = named.join(lost, whole(named, lost), "left").select("id", F.when(F.col("lost_h").isNull(), F.col("text")).alias("text"), "h")
    aligned = align_pieces(spark, f"{scratch.root}/{attempt}", pair_bound(t))
    scratch.drop("tokens", "tokens-again")
    often, least = _frequent(aligned, frequent)
    table = often.select("piece", *_NUMBERS, "groups").toArrow().combine_chunks()
    one = lambda c: table.column(c).combine_chunks() if table.num_rows else pa.array([], table.schema.field(c).type)
    written = pc.binary_join_element_wise(one("groups").cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(";", pa.large_string())).cast(pa.large_binary())
    get = send(spark, (one("piece").cast(pa.string()), [one(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _NUMBERS], written))
    others = aligned.where((F.col("n") < least) | (F.octet_length("piece") > FREQUENT_BYTES)).drop("n") if least else aligned.drop("n")
    found = named.mapInArrow(_places(get, sure), place).join(others, "piece").groupBy("id", "h").agg(F.collect_set(F.struct("pos", *_NUMBERS, "groups")).alias("rare"))
    found = found.withColumnsRenamed({"id": "rare_id", "h": "rare_h"})
    joined = named.join(found.select("rare_id", "rare_h", "rare"), whole(named, found), "left").select("id", "text", "rare")
    numbers = ", ".join(f"{c} long" for c in _NUMBERS)
    out = joined.mapInArrow(_assemble(get, sure), f"id {docs.schema[id_col].dataType.simpleString()}, {numbers}, groups_sha256 string")
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256")
