"""Near-duplicate documents by SimHash fingerprints: multi-index hashing within a Hamming radius.

A fingerprint of 64 bits is cut into m segments. By the pigeonhole principle two fingerprints that differ
in r bits or fewer are close in one segment: with r = s * m + a, within s bits in one of the first a + 1 segments, or within s - 1 in
one of the others. So each fingerprint stands in the table of each segment under its own value, looks up the
values of a small Hamming ball around it, and the complete distances of what it meets are verified. m follows the number of distinct fingerprints, so
that a segment has about as many values as there are fingerprints; any m finds the same links.

Equal fingerprints are one node from the start. A value under which more than HOT nodes stand is not compared pair by pair: all
nodes that look it up are linked through midpoints instead. Two fingerprints within r (even) bits share a point at r / 2 bits or fewer from
both, and two that share such a point are within r bits. So nodes that stand at a point are linked without being compared. In
rounds, each component so far takes one link to the smallest component that it shares a point with, until none has any: no
connection is lost, and rows and links grow with the number of such nodes, not with its square.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from horizonspark.llm.common import Scratch, join_hot, text_bytes
from horizonspark.llm.minhash import BROADCAST_IDS, components

BITS = 64
#: A segment's value with more nodes than this is linked through midpoints.
HOT = 64
#: Bytes of a text that are cut into shingles at a time.
PIECE = 1 << 18
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE bytes, cut at white space; a longer word stays whole."""
    at = 0
    while len(text) - at > PIECE:
        cut = _SPACE.search(text, at + PIECE)
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def _bit_counts(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit; bits are added up as bytes, 255 hashes at a time."""
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, BITS // 8)
    return np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0).view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, k: int = 4, seed: int = 42) -> int:
    """The SimHash of a text's k-word shingles (repeats included), as a signed 64-bit number; 0 without words."""
    held: list[bytes] = []
    counts, n = np.zeros(BITS, np.int64), 0
    digest = xxhash.xxh64_intdigest
    for piece in _pieces(text.lower()):
        words = held + piece.split()
        if len(words) >= k:
            line, sizes = b" ".join(words), [len(w) for w in words]
            starts = [0, *accumulate(x + 1 for x in sizes)]
            ends = [s + x for s, x in zip(starts[k - 1 :], sizes[k - 1 :], strict=False)]
            hashes = [digest(line[s:e], seed) for s, e in zip(starts, ends, strict=False)]
            counts += _bit_counts(hashes)
            n += len(hashes)
        held = words[max(0, len(words) - k + 1) :]
    if not n:
        if not held:
            return 0
        counts, n = _bit_counts([digest(b" ".join(held), seed)]), 1
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, k: int, seed: int) -> DataFrame:
    """(doc_id, fp) of each row, over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), k, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id bigint, fp bigint")


def segments(n: int, radius: int) -> list[tuple[int, int, int]]:
    """(lowest bit, bits, radius) of each segment for n fingerprints: about log2(n) bits each, as many segments as have a radius of their own."""
    m = min(radius, max(2, BITS // max(1, n.bit_length() - 4))) if radius > 1 else radius + 1
    s, a = divmod(radius, m)
    out, at = [], 0
    for i in range(m):
        bits = BITS // m + (i < BITS % m)
        if i <= a or s:
            out.append((at, bits, s if i <= a else s - 1))
        at += bits
    return out


def ball(bits: int, radius: int) -> list[int]:
    """All masks of the lowest bits with radius ones or fewer."""
    return [sum(1 << i for i in at) for r in range(radius + 1) for at in combinations(range(bits), r)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _moved(value: Column, masks: list[int]) -> Column:
    """The value with each mask's bits flipped; the masks are one literal, as an expression for each of thousands would slow planning."""
    held = F.split(F.lit(",".join(str(_signed(m)) for m in masks)), ",").cast("array<bigint>")
    return F.transform(held, lambda m: value.bitwiseXOR(m))


def _segment(i: int, low: int, bits: int) -> Column:
    """A segment's value, and its number above it."""
    mask = (1 << bits) - 1
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(mask).cast("bigint")) + F.lit(i << 32).cast("bigint")


def hamming_links(nodes: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """Links (a, b), a < b, within radius bits between distinct fingerprints fp of nodes: enough of them to connect all that are linked."""
    if radius % 2:
        raise ValueError("midpoints need an even radius")
    cut = segments(nodes.count(), radius)
    homes = nodes.select("fp", F.explode(F.array(*[_segment(i, low, bits) for i, (low, bits, _) in enumerate(cut)])).alias("key"))
    looks = nodes.select("fp", F.explode(F.concat(*[_moved(_segment(i, low, bits), ball(bits, r)) for i, (low, bits, r) in enumerate(cut)])).alias("key"))
    hot = scratch.save(homes.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key"))
    n_hot = hot.count()
    if n_hot:
        known = F.broadcast(hot) if n_hot <= BROADCAST_IDS else hot
        crowd = scratch.save(looks.join(known, "key", "left_semi").select("fp").distinct())
        homes, looks = homes.join(known, "key", "left_anti"), looks.join(known, "key", "left_anti")
    met = homes.select("key", F.col("fp").alias("a")).join(looks.select("key", F.col("fp").alias("b")), "key")
    met = met.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    links = scratch.save(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return links.union(midpoint_links(crowd, radius, scratch)) if n_hot else links


def midpoint_links(crowd: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """Links as above for the fingerprints of crowd, at most one for each: through points at radius / 2 bits or fewer.

    A point has no more nodes than points stand around it (2,081 for radius 4).
    """
    masks, at_point = ball(BITS, radius // 2), Window.partitionBy("point")
    comp, links = crowd.select("fp", F.col("fp").alias("comp")), []
    while True:
        points = comp.select("fp", "comp", F.explode(_moved(F.col("fp"), masks)).alias("point"))
        lower = points.withColumn("low", F.min(F.struct("comp", "fp")).over(at_point)).where("low.comp < comp")
        best = scratch.save(lower.groupBy("comp").agg(F.min(F.struct("low.comp", "low.fp", F.col("fp").alias("own"))).alias("m")).select("comp", F.col("m.comp").alias("low"), "m.fp", "m.own"))
        n = best.count()
        if not n:
            break
        links.append(best.select(F.least("fp", "own").alias("a"), F.greatest("fp", "own").alias("b")))
        joined = components(best.select(F.col("low").alias("a"), F.col("comp").alias("b")), scratch).select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        joined = F.broadcast(joined) if n <= BROADCAST_IDS else joined
        comp = scratch.save(comp.join(joined, "comp", "left").select("fp", F.coalesce("root", "comp").alias("comp")))
    return reduce(DataFrame.union, links) if links else crowd.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable by links), kept.

    Fingerprints link when they differ in radius bits or fewer. A text without words (null and empty ones too) has
    fingerprint zero, which links like any other; texts of any length are read whole, a piece at a time. Rows with a null id have a
    fingerprint, but link nothing, and their component_id is null and kept false. Rows that repeat an id are one
    document, linked by each of its texts. Ties do not arise, as the smallest id decides. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs, id_col, text_col, shingle_words, seed))
    named = rows.where("doc_id is not null")
    nodes = scratch.save(named.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    links = hamming_links(nodes.select("fp"), radius, scratch)
    repeats = scratch.save(named.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.count("*").alias("n")).where("a < z").select("doc_id", "a", "n"))
    same = join_hot(named, repeats, ["doc_id"], "n").where("a < fp").select("a", F.col("fp").alias("b")).distinct()
    comp = components(links.union(same), scratch).withColumnRenamed("node", "fp")
    rooted = scratch.save(nodes.join(comp, "fp", "left").select("fp", "low", "n", F.coalesce("comp", "fp").alias("root")))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("size"))
    classes = scratch.save(join_hot(rooted, scratch.save(lows), ["root"], "size").select("fp", "n", "component_id"))
    out = join_hot(rows, classes, ["fp"], "n", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )
