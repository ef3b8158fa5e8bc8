"""Benchmark passages in documents, by CGK embedding and bit-sampling LSH.

Texts are compared as lower-cased (A-Z) words joined by single spaces. An item of
L bytes allows floor(L / 12) - 1 edits (none below 24 bytes). The CGK embedding is a random walk along a
text: at each step it copies the byte it stands on, and moves on if a random bit of (step, byte) says so. Walks
with the same bits over two texts of small edit distance meet again after an edit, so their copies have a small Hamming distance.
In a document a walk starts at every `stride`-th byte, so an item-sized window holds many; in an
item one starts at every byte. What a walk copies at some sampled steps is an LSH key; `walks` times `samplings`
keys a start repeat the sampling. Keys of documents that no item has are dropped where the text is, by a bit table of bounded size;
the others are joined to the items' keys in Spark and propose a window, which is verified by its exact edit distance.

Recall by length and at the largest allowed number of random edits is measured in the tests (0.99 at least). Keys that many items
share (a common opening) are left out for items that have enough others, that is as many starts as the shortest item of
the class, for which that recall holds too; the other items keep all of theirs.
Items below 24 bytes are looked for word by word, as they allow no edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from horizonspark.llm.common import Scratch, text_bytes, unused
from horizonspark.llm.shingles import mix

BYTES_AN_EDIT = 12
SHORT = 2 * BYTES_AN_EDIT
_BLOCK = 1 << 18
_CHUNK = 1 << 14
_GRAM = 3
#: A key that more items than this share is left out where it can be.
COMMON = 32
#: Items' keys searched for in one reading of the documents (their bit table then has 32 MB at most), and keys broadcast for the join.
KEYS_A_PASS, BROADCAST_KEYS = 1 << 24, 500_000
#: Up to so many texts (16 bytes each) are broadcast to pick rows by text; more are joined by a shuffle.
BROADCAST_TEXTS = 500_000


@dataclass(frozen=True)
class Class:
    """How items of least bytes and more (up to the next class) are embedded; starts is what an item of that length has, about."""

    least: int
    stride: int
    steps: int
    sampled: int
    starts: int
    walks: int = 2
    samplings: int = 2


CLASSES = (Class(SHORT, 2, 20, 10, 14), Class(64, 4, 48, 16, 40))


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def normal_column(text: Column) -> Column:
    """The same as normal, as bytes, without Python."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, "[ \\t\\n\\x0B\\f\\r]+", " ")).cast("binary")


def allowed(length: int) -> int:
    return max(0, length // BYTES_AN_EDIT - 1)


def edit_match(item: bytes, region: bytes, limit: int) -> tuple[int, int] | None:
    """(fewest edits, where the match ends) of the item within the region, or None beyond limit: Myers' bit vectors."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(region):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= limit else None


def verified(item: bytes, region: bytes) -> tuple[int, int, int] | None:
    """(edits, start, stop) of the item's best place in the region, if within the allowed edits.

    An edit spoils at most three of the item's 3-grams, so a region that lacks more of them need not be compared.
    """
    limit = allowed(len(item))
    if not limit:
        at = (b" " + region + b" ").find(b" " + item + b" ")
        return (0, at, at + len(item)) if at >= 0 else None
    grams = ({t[i : i + _GRAM] for i in range(len(t) - _GRAM + 1)} for t in (item, region))
    if len(next(grams) - next(grams)) > _GRAM * limit:
        return None
    m = edit_match(item, region, limit)
    if not m:
        return None
    back = edit_match(item[::-1], region[: m[1]][::-1], limit)
    return m[0], m[1] - back[1], m[1]


class Embedding:
    """The walks of one class, and the keys of starts in a text."""

    def __init__(self, number: int, seed: int):
        self.of, rng = CLASSES[number], np.random.default_rng([seed, number])
        shape = (self.of.walks, self.of.steps)
        # a byte moves the walk on if the top bit of multiplier * byte + offset, both of the step, is set
        self.factor, self.offset = rng.integers(0, 256, shape, dtype=np.uint8) | np.uint8(1), rng.integers(0, 256, shape, dtype=np.uint8)
        self.steps = np.array([[np.isin(np.arange(self.of.steps), rng.choice(self.of.steps, self.of.sampled, replace=False)) for _ in range(self.of.samplings)] for _ in range(self.of.walks)])
        self.salt = rng.integers(0, 1 << 63, (self.of.walks, self.of.samplings), dtype=np.uint64)

    def keys(self, text: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys, where the walk ends) for each walk and sampling."""
        odd = np.uint64(0x9E3779B97F4A7C15)
        byte, move = np.empty(len(starts), np.uint8), np.empty(len(starts), np.uint8)
        for w in range(self.of.walks):
            at = starts.astype(np.intp)
            out = [np.full(len(at), salt, np.uint64) for salt in self.salt[w]]
            for j in range(self.of.steps):
                np.take(text, at, out=byte, mode="clip")
                for key, sampled in zip(out, self.steps[w, :, j], strict=True):
                    if sampled:
                        key *= odd
                        key += byte
                np.multiply(byte, self.factor[w, j], out=move)
                np.add(move, self.offset[w, j], out=move)
                np.right_shift(move, 7, out=move)
                np.add(at, move, out=at)
            for key in out:
                yield mix(key), at


def _word_keys(text: np.ndarray, lengths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, starts) of the runs of whole words that have one of the lengths; text starts and ends with a separator (a byte up to 32)."""
    apart = text <= 32
    starts = np.flatnonzero(apart[:-1] & ~apart[1:]) + 1
    for length in lengths:
        at = starts[starts + length < len(text)]
        at = at[apart[at + length] & ~apart[at + length - 1]]
        key = np.full(len(at), length, np.uint64)
        inside = np.ones(len(at), bool)
        for j in range(length):
            c = text[at + j]
            key = key * np.uint64(0x9E3779B97F4A7C15) + c
            inside &= c != 10
        yield mix(key[inside]), at[inside]


def _item_keys(seed: int):
    """From (item, text): every key of each item, with its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embeddings = [Embedding(i, seed) for i in range(len(CLASSES))]
        for batch in batches:
            for item, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: list[tuple[np.ndarray, np.ndarray]] = []
                if len(t) < SHORT:
                    found += [(k, a[:1] * 0) for k, a in _word_keys(np.frombuffer(b"\n" + t + b"\n", np.uint8), [len(t)])]
                else:
                    e = [e for e in embeddings if e.of.least <= len(t)][-1]
                    text = np.frombuffer(t, np.uint8)
                    for lo in range(0, len(t), _BLOCK):
                        starts = np.arange(lo, min(len(t), lo + _BLOCK))
                        found += [(k[end < len(t)], starts[end < len(t)]) for k, end in e.keys(text, starts)]
                for key, at in found:
                    n = len(key)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array([item] * n, pa.binary()), pa.array(at.astype(np.int64)), pa.array(np.full(n, len(t), np.int64))], names=["key", "item", "at", "length"]
                    )

    return run


class Sieve:
    """Which keys some item has, by a bit table (a few others pass too); built from the table's non-zero 64-bit words."""

    def __init__(self, bits: int, word: np.ndarray, mask: np.ndarray, classes: list[int], lengths: list[int], seed: int):
        table = np.zeros(1 << (bits - 6), np.uint64)
        table[word] = mask.view(np.uint64)
        self.table, self.shift, self.classes, self.lengths, self.seed = table.view(np.uint8), np.uint64(64 - bits), classes, lengths, seed

    def passing(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys whose two bits, by their first 28 bits and the next 28, are set."""
        some = np.flatnonzero(self._set(keys))
        return some[self._set(keys[some] << np.uint64(28))]

    def _set(self, keys: np.ndarray) -> np.ndarray:
        slot = keys >> self.shift
        return (self.table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & np.uint8(1)).view(bool)


def _text_keys(shared):
    """From raw texts: (key, text, pos) of the keys that pass the sieve, text being the digest of the raw text and pos a byte of the normalised one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = shared.value
        embeddings = [Embedding(i, sieve.seed) for i in sieve.classes]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                raw = batch.column(0).slice(at, 256).to_pylist()
                texts = [normal(t) for t in raw]
                for numbers, block, starts, skipped in _joined(texts):
                    yield from _block_keys(sieve, embeddings, raw, texts, numbers, block, starts, skipped)

    return run


def _joined(texts: list[bytes]) -> Iterator[tuple[list[int], bytes, list[int], int]]:
    """(text numbers, block, their starts in it, bytes of the text before it): texts between line breaks, many to a block; long ones in blocks that overlap."""
    held: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if len(t) > _BLOCK:
            for lo in range(0, len(t), _BLOCK):
                # a block starts where a stride and, for short items, the byte before allows
                yield [i], (t[lo - 1 : lo] or b"\n") + t[lo : lo + _BLOCK + 256] + b"\n", [1], lo
            continue
        if held and size + len(t) > _BLOCK:
            yield _together(texts, held)
            held, size = [], 0
        held.append(i)
        size += len(t) + 1
    if held:
        yield _together(texts, held)


def _together(texts: list[bytes], held: list[int]) -> tuple[list[int], bytes, list[int], int]:
    starts = np.cumsum([1] + [len(texts[i]) + 1 for i in held[:-1]])
    return held, b"\n" + b"\n".join(texts[i] for i in held) + b"\n", starts.tolist(), 0


def _block_keys(sieve: Sieve, embeddings: list[Embedding], raw: list[bytes], texts: list[bytes], numbers: list[int], block: bytes, starts: list[int], skipped: int) -> Iterator[pa.RecordBatch]:
    text = np.frombuffer(block, np.uint8)
    first = np.array(starts)
    stop = np.append(first[1:] - 1, len(block) - 1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for e in embeddings:
        # one block's own starts, each text's from its first byte on
        own = np.minimum(stop, first + _BLOCK)
        n = -(-(own - first) // e.of.stride)
        of = np.repeat(np.arange(len(first)), n)
        pos = first[of] + (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * e.of.stride
        for lo in range(0, len(pos), _CHUNK):
            here, ends = pos[lo : lo + _CHUNK], stop[of[lo : lo + _CHUNK]]
            for key, end in e.keys(text, here):
                ok = sieve.passing(key)
                ok = ok[end[ok] < ends[ok]]
                if len(ok):
                    found.append((key[ok], here[ok]))
    for key, at in _word_keys(text, sieve.lengths):
        ok = sieve.passing(key)
        if len(ok):
            found.append((key[ok], at[ok]))
    if not found:
        return
    key, pos = (np.concatenate(x) for x in zip(*found, strict=True))
    of = np.searchsorted(first, pos, "right") - 1
    digests = {i: hashlib.md5(raw[numbers[i]]).digest() for i in np.unique(of).tolist()}
    yield pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array([digests[i] for i in of.tolist()], pa.binary()), pa.array((pos - first[of] + skipped).astype(np.int64))], names=["key", "text", "pos"]
    )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, item, lo, region, item_text): those that match, with place."""
    for b in batches:
        rows = []
        for text, item, lo, region, t in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if m := verified(t, region):
                rows.append((text, item, m[0], lo + m[1], lo + m[2]))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        types = (pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["text", "item", "edits", "start", "stop"])


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([normal(t) for t in b.column(1).to_pylist()], pa.binary())], names=["item_id", "item_text"])


def digest(text_col: str) -> Column:
    """By which equal texts are taken together; null as empty."""
    return F.unhex(F.md5(text_bytes(text_col)))


def _few(df: DataFrame, n: int, limit: int) -> DataFrame:
    return F.broadcast(df) if n <= limit else df


def _keys(items: DataFrame, scratch: Scratch, seed: int) -> DataFrame:
    """(key, item, at, length): the items' keys without those that many share, where an item has enough others."""
    every = scratch.save(items.mapInArrow(_item_keys(seed), "key bigint, item binary, at bigint, length bigint"))
    shared = scratch.save(every.groupBy("key").agg(F.countDistinct("item").alias("n")).where(F.col("n") > COMMON).select("key"))
    if shared.isEmpty():
        return every
    marked = every.join(shared.withColumn("common", F.lit(True)), "key", "left")
    need = F.lit(0)
    for c in CLASSES:
        need = F.when(F.col("length") >= c.least, c.starts).otherwise(need)
    enough = marked.where("common is null").groupBy("item", "length").agg(F.countDistinct("at").alias("rare")).where((F.col("length") >= SHORT) & (F.col("rare") >= need)).select("item", F.lit(True).alias("enough"))
    return scratch.save(marked.join(enough, "item", "left").where("common is null or enough is null").select("key", "item", "at", "length"))


def _survivors(texts: DataFrame, keys: DataFrame, n: int, scratch: Scratch, seed: int) -> Iterator[DataFrame]:
    """(key, text, pos), pass by pass over the texts: one for each KEYS_A_PASS of the items' keys."""
    sc = texts.sparkSession.sparkContext
    passes = max(1, -(-n // KEYS_A_PASS))
    for p in range(passes):
        some = keys if passes == 1 else keys.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(passes)) == p)
        bits = min(28, max(12, (32 * -(-n // passes)).bit_length()))
        slots = some.select(F.explode(F.array(F.shiftrightunsigned("key", 64 - bits), F.shiftrightunsigned(F.shiftleft("key", 28), 64 - bits))).alias("slot"))
        words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("mask")).toArrow()
        lengths = [r["length"] for r in some.where(F.col("length") < SHORT).select("length").distinct().orderBy("length").collect()]
        bounds = [*(c.least for c in CLASSES), None]
        tops = some.agg(*[F.max((F.col("length") >= lo) & (F.col("length") < hi) if hi else F.col("length") >= lo) for lo, hi in zip(bounds, bounds[1:], strict=False)]).first()
        sieve = Sieve(bits, words.column("word").to_numpy(), words.column("mask").to_numpy(), [i for i, held in enumerate(tops) if held], lengths, seed)
        shared = sc.broadcast(sieve)
        yield scratch.save(texts.mapInArrow(_text_keys(shared), "key bigint, text binary, pos bigint"))
        shared.unpersist()


def text_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", seed: int = 8) -> DataFrame:
    """(text, item_id, edits, start, stop): for each distinct text (by digest) the best place of each item it holds, in bytes of the normalised text.

    Of equally good places the first is taken. Items with null id or without words match nothing; of repeated items each is reported. Null and
    empty texts hold none; repeated texts are searched, proposed and verified once. Whole texts of any length are read.
    The benchmark is the query set: it never meets the texts but by keys, in one reading of them for each KEYS_A_PASS (16 million) keys, four a byte of the items.
    """
    scratch = Scratch(docs.sparkSession, "decontam")
    asked = benchmark.select(F.col(item_id).cast("bigint").alias("item_id"), text_bytes(item_text).alias("t")).where("item_id is not null")
    named = scratch.save(asked.mapInArrow(_normal, "item_id bigint, item_text binary").where("octet_length(item_text) > 0").withColumn("item", F.unhex(F.md5("item_text"))))
    items = scratch.save(named.select("item", "item_text").dropDuplicates(["item"]))
    keys = _keys(items, scratch, seed)
    n = keys.count()
    length = F.col("length")
    edits = F.when(length < SHORT, 0).otherwise(F.floor(length / BYTES_AN_EDIT) - 1)
    windows = None
    for found in _survivors(docs.select(text_bytes(text_col).alias("t")), keys, n, scratch, seed):
        joined = found.join(_few(keys, n, BROADCAST_KEYS), "key")
        # places of an item within its length of each other are verified together
        some = joined.select("text", "item", "length", F.floor(F.greatest(F.col("pos") - F.col("at"), F.lit(0)) / length).alias("nth")).distinct()
        windows = some if windows is None else windows.union(some)
    windows = scratch.save(windows.distinct().select("text", "item", F.greatest(F.lit(0), F.col("nth") * length - edits - 1).alias("lo"), (2 * length + 3 * edits + 2).alias("size")))
    wanted = scratch.save(windows.select("text").distinct())
    texts = docs.select(digest(text_col).alias("text"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(_few(wanted, wanted.count(), BROADCAST_TEXTS), "text", "left_semi")
    texts = texts.groupBy("text").agg(F.first("t").alias("t")).select("text", normal_column(F.col("t")).alias("t"))
    # regions of the texts, without the texts, go on
    regions = texts.join(windows, "text").select("text", "item", "lo", F.expr("substring(t, cast(lo + 1 as int), cast(size as int))").alias("region"))
    hits = regions.join(items, "item").select("text", "item", "lo", "region", "item_text").mapInArrow(_verify, "text binary, item binary, edits int, start bigint, stop bigint")
    best = hits.groupBy("text", "item").agg(F.min(F.struct("edits", "start", "stop")).alias("best"))
    return scratch.save(best.join(named.select("item", "item_id"), "item").select("text", "item_id", "best.edits", "best.start", "best.stop"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, edits, start, stop. Clean documents have none.

    A row of docs is a document, whatever its id (null or repeated); other columns are ignored; empty tables give an empty result. See text_hits.
    """
    hits = text_hits(docs, benchmark, text_col, **options)
    mine = docs.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("text"))
    return mine.join(_few(hits, hits.count(), BROADCAST_TEXTS), "text").select("doc_id", "item_id", "edits", "start", "stop")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without the documents that hold a benchmark item; all columns and other rows as they are, repeated ones too."""
    text = unused(docs, "_text")
    hits = text_hits(docs, benchmark, text_col, **options).select(F.col("text").alias(text)).distinct()
    return docs.withColumn(text, digest(text_col)).join(_few(hits, hits.count(), BROADCAST_TEXTS), text, "left_anti").drop(text).select(*[F.col(f"`{c}`") for c in docs.columns])
