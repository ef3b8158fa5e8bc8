"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian verification, exact confirmation.

Equal shingle sets are one node from the start, so a group of copies costs one
signature. Nodes that share a band's key are candidates. A bucket is never
expanded into rows for all its pairs. First each bucket compares its members with its
smallest one (a star, linear in the bucket). Members that have met in one component need
no more comparisons; a bucket whose members have not is compared on: a small one as rows. The members of larger ones are
grouped anew by their rarest shingles, which is exact: under one order of all shingles, two sets of similarity t, the smaller x and the larger y, share one of the first
|x| - 2t/(1+t)|x| + 1 of x and one of the first |y| - t|y| + 1 of y. So members meet in such a group only if x's part of its own is small
enough for a link, and texts that share a long template but no more meet in none. Groups are resolved like buckets: small ones as rows, a star in the others; what a star has not united there is compared
in blocks of bounded bytes, those outside the main component with all. So no bucket is capped,
no link between components is lost to a bucket's size, and what is emitted stays linear.

A pair's signatures are compared batch by batch. After n positions with m
matches, under a uniform prior on the similarity J, P(J >= t | m, n) is a
binomial tail; once it falls below `miss` the pair is dropped. Survivors are
confirmed on their full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horizonspark.llm.common import Scratch, join_hot, text_bytes
from horizonspark.llm.shingles import _ODD, mix, shingle_sets

#: Up to so many edges are united in one task (about 200 bytes of memory each).
FEW_EDGES = 500_000
#: Up to so many ids are broadcast to pick rows by id (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Buckets of up to so many members are compared as rows, larger ones in blocks.
ROWS = 16
#: The same for groups of a rare shingle.
GROUP = 64
#: Counters of the sketch that orders shingles by how often they occur; a wrong count costs comparisons, not links.
COUNTERS = 1 << 20
#: Bytes of signatures and sets in a block, about.
BLOCK_BYTES = 4 << 20


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The smallest m with P(J >= threshold | m of n matches) >= miss, J uniform before."""
    tail = 0.0
    for m in range(n + 1):
        tail += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n - m + 2) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
        if tail >= miss:
            return m
    return n


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(1, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (x[i : i + 2048, None] * a + b).min(axis=0), out=low)
    return low


def _features(k: int, bands: int, rows: int):
    a, b = _permutations(bands * rows)
    odd = np.random.default_rng(8).integers(1, 1 << 63, (bands, rows), dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets([t.lower() for t in part.column(1).to_pylist()], k)
                sigs = [signature(s, a, b) if len(s) else None for s in sets]
                keys = [None if s is None else ((s.reshape(bands, rows) * odd).sum(axis=1) * np.uint64(bands) + np.arange(bands, dtype=np.uint64)).view(np.int64) for s in sigs]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([None if s is None else s.tobytes() for s in sigs], pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "sig", "bands"],
                )

    return run


def _frugal(run):
    """run, after which what Arrow's pool holds unused is given back: workers stay, and an executor's memory has to do for all of them."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return held


def _bayes(positions: int, batch: int, threshold: float, miss: float):
    steps = [(lo, min(positions, lo + batch), least_matches(min(positions, lo + batch), threshold, miss)) for lo in range(0, positions, batch)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, positions) for c in (2, 3))
            alive, seen = np.arange(len(x)), np.zeros(len(x), np.int64)
            for lo, hi, need in steps:
                seen[alive] += (x[alive, lo:hi] == y[alive, lo:hi]).sum(axis=1)
                alive = alive[seen[alive] >= need]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(alive)), b.column(1).take(pa.array(alive))], names=["a", "b"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets([t.lower() for t in part.column(1).to_pylist()], k)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets' similarity is num / den or more."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return den * both >= num * (len(x) + len(y) - both)


def _earlier(groups: pd.Series, homes: pd.Series, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Which groups of smaller keys each member stands in, and is at home in: a row for each member, a column for each such group."""
    column = {k: c for c, k in enumerate(sorted({k for ks in groups for k in ks if k < key}))}
    out = []
    for lists in (groups, homes):
        marks = np.zeros((len(lists), len(column)), bool)
        for i, ks in enumerate(lists):
            marks[i, [column[k] for k in ks if k < key]] = True
        out.append(marks)
    return out[0], out[1]


def _blocks(positions: int, batch: int, threshold: float, miss: float, num: int, den: int):
    """Links that join components between the first and the second members of one pair of blocks of a group."""
    steps = [(lo, min(positions, lo + batch), least_matches(min(positions, lo + batch), threshold, miss)) for lo in range(0, positions, batch)]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(group["sig"]), np.uint32).reshape(-1, positions)
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        n = np.array([len(x) for x in sets])
        comp, node, first, other, home = (group[c].to_numpy() for c in ("comp", "node", "first", "other", "home"))
        # the groups of smaller keys that members stand in and are at home in
        stands, at_home = _earlier(group["groups"], group["homes"], key[0])
        root = {c: c for c in comp.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out: list[tuple[int, int]] = []
        second = np.flatnonzero(~first)
        for i in np.flatnonzero(first).tolist():
            # each pair once: with the main component's members, and with those of the others that come later
            with_i = second[(comp[second] != comp[i]) & (~other[second] | (node[second] > node[i]))]
            # the smaller one of a pair is at home here, and not too small
            with_i = with_i[(home[with_i] & (n[with_i] <= n[i])) | (home[i] & (n[with_i] >= n[i]))]
            # the first group where a pair meets so is where it is compared
            met = (at_home[with_i] & stands[i]).any(axis=1) & (n[with_i] <= n[i]) | (stands[with_i] & at_home[i]).any(axis=1) & (n[with_i] >= n[i])
            with_i = with_i[~met]
            with_i = with_i[den * np.minimum(n[with_i], n[i]) >= num * np.maximum(n[with_i], n[i])]
            seen = np.zeros(len(with_i), np.int64)
            for lo, hi, need in steps:
                seen += (sig[with_i, lo:hi] == sig[i, lo:hi]).sum(axis=1)
                alive = seen >= need
                with_i, seen = with_i[alive], seen[alive]
            for j in with_i[np.argsort(-seen, kind="stable")].tolist():
                a, b = find(int(comp[i])), find(int(comp[j]))
                if a != b and _linked(sets[i], sets[j], num, den):
                    root[max(a, b)] = min(a, b)
                    out.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) % COUNTERS


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each counter's shingles occur in a task's sets."""
    held = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for x in batch.column(0):
            np.add.at(held, _counter(np.frombuffer(x.as_buffer(), np.uint64)), 1)
    at = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], names=["counter", "c"])


def prefix_lengths(n: int, num: int, den: int) -> tuple[int, int]:
    """Of a set of n shingles in order, how many it is looked up by as the smaller and as the larger one of a pair of similarity num / den or more."""
    both = -(-2 * num * n // (num + den))
    return n - both + 1, n - -(-num * n // den) + 1


def _prefixes(counts, num: int, den: int):
    """(key, node, size, home) of each set's rarest shingles; home: the set may be the smaller one of a pair that meets there.

    Keys are of a shingle and a class of sizes, each as wide as the sizes of a pair may differ; a set meets the smaller ones in its own class and the one below.
    """
    wide = max(1e-9, math.log(den / num))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counts.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, nodes, sizes, homes = [], [], [], []
                for node, x in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    h = np.frombuffer(x.as_buffer(), np.uint64)
                    small, large = prefix_lengths(len(h), num, den)
                    first = h[np.lexsort((h, of[_counter(h)]))[:large]]
                    own = int(math.log(len(h)) / wide)
                    for kind in (own, own - 1):
                        keys.append(mix(first + np.uint64((kind + 2) * int(_ODD) % (1 << 64))).view(np.int64))
                        nodes.append(np.full(len(first), node, np.int64))
                        sizes.append(np.full(len(first), len(h), np.int64))
                        homes.append((np.arange(len(first)) < small) & (kind == own))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, nodes, sizes, homes)], names=["key", "node", "size", "home"])

    return run


def _confirm(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                if _linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), num, den):
                    keep.append(i)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take)], names=["a", "b"])

    return run


def few_broadcast(df: DataFrame) -> DataFrame:
    """A saved table, to be broadcast if it has few rows; else Spark joins it as it sees fit."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, comp) of all edges that one task reads."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(root.setdefault(a, a)), find(root.setdefault(b, b))
            root[max(x, y)] = min(x, y)
    nodes = sorted(root)
    for at in range(0, len(nodes), 1 << 16):
        part = nodes[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["node", "comp"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for every node of the edges (a, b): comp is the smallest node reachable.

    Up to FEW_EDGES edges are united by one task, whose memory that number bounds. More take rounds of
    minimum over neighbours, then a pointer jump, until nothing changes; the result is the same.
    """
    edges = scratch.save(edges.select("a", "b").distinct())
    if edges.count() <= FEW_EDGES:
        return scratch.save(edges.coalesce(1).mapInArrow(_united, "node bigint, comp bigint"))
    both = scratch.save(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp"), F.count("*").alias("degree")))
    few = labels.count() <= BROADCAST_IDS
    while True:
        if few:
            known = F.broadcast(labels)
            ends = both.join(known, both.b == labels.node).select("a", "comp")
        else:  # a star's centre is the end of many edges
            known = labels
            ends = join_hot(both.withColumnRenamed("b", "node"), labels, ["node"], "degree").select("a", "comp")
        near = ends.groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        step = near.join(known, "node").select("node", F.least("comp", "low").alias("next"), "comp", "degree")
        jump = known.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        moved = scratch.save(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("next"), "comp", "degree"))
        settled = moved.where("next < comp").isEmpty()
        labels = moved.select("node", F.col("next").alias("comp"), "degree")
        if settled:
            return labels.select("node", "comp")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 5,
    batch: int = 32,
    miss: float = 1e-5,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents link when their shingle sets' Jaccard similarity is percent / 100 or
    more; component_id is the smallest id reachable. At exactly 0.8 similarity,
    32 bands of 5 miss a pair with probability 3e-6, and `miss` bounds what the
    posterior drops. Texts without words (null and empty ones too) link with
    nothing. Rows with a null id have a null component_id and aren't kept; rows that
    repeat an id are one document, linked if any of its texts is. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text"))
    feats = scratch.save(src.mapInArrow(_frugal(_features(shingle_words, bands, rows)), "doc_id bigint, n_shingles bigint, set_key binary, sig binary, bands array<bigint>"))
    real = feats.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.save(real.groupBy("set_key").agg(F.min("doc_id").alias("node")))
    reps = real.join(classes, (real.doc_id == classes.node) & (real.set_key == classes.set_key), "left_semi").withColumnRenamed("doc_id", "node")
    dealt = reps.select("node", F.explode("bands").alias("band"))
    shared = scratch.save(dealt.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1"))
    members = scratch.save(join_hot(dealt, shared, ["band"], "n").select("band", "node", "hub"))
    nodes = scratch.save(members.select("node").distinct())
    known = scratch.save(reps.join(few_broadcast(nodes), "node", "left_semi").dropDuplicates(["node", "set_key"]).select("node", "n_shingles", "sig", "bands"))
    texts = src.withColumnRenamed("doc_id", "node").where(F.col("node").isNotNull())
    check = (known, texts, scratch, shingle_words, percent, bands * rows, batch, miss)

    star = scratch.save(members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    links = _verified(star, *check)
    comp = components(links, scratch)

    # what the stars have not united: buckets whose other members are in several components
    held = members.where("node <> hub").select("band", "node").join(few_broadcast(comp), "node", "left").select("band", "node", F.coalesce("comp", "node").alias("comp"))
    held = scratch.save(held)
    state = held.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("band", "n")
    held = scratch.save(join_hot(held, scratch.save(state), ["band"], "n"))
    few = held.where(F.col("n") <= ROWS)
    left, right = few.select("band", F.col("node").alias("a"), F.col("comp").alias("ca")), few.select("band", F.col("node").alias("b"), F.col("comp").alias("cb"))
    pairs = scratch.save(left.join(right, "band").where("a < b and ca <> cb").select("a", "b").distinct().join(star, ["a", "b"], "left_anti"))
    links = links.union(_verified(pairs, *check))
    large = held.where(F.col("n") > ROWS)
    if not large.isEmpty():
        links = links.union(_by_rare_shingles(scratch.save(large.select("node", "comp").distinct()), check))
    comp = components(links, scratch)
    roots = classes.join(comp, "node", "left").select("set_key", F.coalesce("comp", "node").alias("root"))
    out = feats.select("doc_id", "n_shingles", "set_key").join(roots, "set_key", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _full_sets(ids: DataFrame, texts: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """(node, shingles) of the nodes in ids, read again from the texts."""
    picked = texts.join(few_broadcast(scratch.save(ids)), "node", "left_semi")
    return scratch.save(picked.mapInArrow(_frugal(_sets(k)), "node bigint, shingles binary").distinct())


def _verified(pairs: DataFrame, known: DataFrame, texts: DataFrame, scratch: Scratch, k: int, percent: int, positions: int, batch: int, miss: float) -> DataFrame:
    """Those of the distinct pairs (a, b) that link."""
    both = pairs.join(known.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(known.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")
    likely = scratch.save(both.mapInArrow(_frugal(_bayes(positions, batch, percent / 100, miss)), "a bigint, b bigint").distinct())
    if likely.isEmpty():
        return likely
    sets = _full_sets(likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct(), texts, scratch, k)
    full = likely.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb")), "b").select("a", "b", "xa", "xb")
    return scratch.save(full.mapInArrow(_frugal(_confirm(percent, 100)), "a bigint, b bigint").distinct())


def _by_rare_shingles(members: DataFrame, check: tuple) -> DataFrame:
    """Links between the components of members (node, comp), found in groups of their rarest shingles."""
    known, texts, scratch, k, percent, positions, batch, miss = check
    spark = members.sparkSession
    sets = _full_sets(members.select("node"), texts, scratch, k)
    counted = sets.select("shingles").mapInArrow(_frugal(_sketch), "counter bigint, c bigint").groupBy("counter").agg(F.sum("c").alias("c")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[counted.column("counter").to_numpy()] = counted.column("c").to_numpy()
    keys = sets.mapInArrow(_frugal(_prefixes(spark.sparkContext.broadcast(counts), percent, 100)), "key bigint, node bigint, size bigint, home boolean").join(few_broadcast(members), "node")
    keys = scratch.save(keys.distinct())
    open_ = F.max("comp") > F.min("comp")
    groups = keys.groupBy("key").agg(F.count("*").alias("n"), F.min(F.when(F.col("home"), F.struct("node", "comp"))).alias("hub"), open_.alias("open")).where("open and hub is not null").drop("open")
    keys = scratch.save(join_hot(keys, scratch.save(groups), ["key"], "n"))
    few, many = keys.where(F.col("n") <= GROUP), keys.where(F.col("n") > GROUP)
    near = f"sx <= sy and 100 * sx >= {percent} * sy"
    met = few.where("home").select("key", F.col("node").alias("x"), F.col("comp").alias("cx"), F.col("size").alias("sx")).join(few.select("key", F.col("node").alias("y"), F.col("comp").alias("cy"), F.col("size").alias("sy")), "key")
    met = met.where(f"x <> y and cx <> cy and {near}").select("x", "y")
    star = many.where("hub.comp <> comp").select(F.col("hub.node").alias("x"), F.col("node").alias("y"))
    pairs = scratch.save(met.union(star).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    links = _verified(pairs, *check)
    if many.isEmpty():
        return links
    whole = components(links.union(members.where("node <> comp").select(F.col("comp").alias("a"), F.col("node").alias("b"))), scratch)
    held = many.drop("comp", "hub", "n", "size").join(few_broadcast(whole), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    held = scratch.save(held)
    state = scratch.save(held.groupBy("key").agg(F.count("*").alias("n"), open_.alias("open")).where("open").drop("open"))
    held = scratch.save(join_hot(held, state, ["key"], "n"))
    return links if held.isEmpty() else links.union(_compared_in_blocks(held, sets, check))


def _compared_in_blocks(held: DataFrame, sets: DataFrame, check: tuple) -> DataFrame:
    """Links between components within the groups of (key, node, comp, home), a pair of blocks in a task."""
    known, _, scratch, _, percent, positions, batch, miss = check
    sizes = held.groupBy("key", "comp").agg(F.count("*").alias("n"))
    main = scratch.save(sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("n")).select("key", "n", F.col("m.comp").alias("main")))
    weighed = join_hot(held.select("key", "node", "comp", "home"), main, ["key"], "n").select("key", "node", "comp", "home", (F.col("comp") != F.col("main")).alias("other"))
    weighed = scratch.save(weighed.join(known.select("node", (2 * F.octet_length("sig") + 8 * F.col("n_shingles")).alias("size")), "node"))
    blocks = weighed.groupBy("key").agg(
        F.count("*").alias("n"),
        F.ceil(F.sum("size") / BLOCK_BYTES).cast("int").alias("n_all"),
        F.ceil(F.sum(F.when(F.col("other"), F.col("size")).otherwise(0)) / BLOCK_BYTES).cast("int").alias("n_others"),
    )
    rows_of = join_hot(weighed, scratch.save(blocks), ["key"], "n")
    i, j = F.pmod(F.xxhash64("node"), F.col("n_others")).cast("int"), F.pmod(F.xxhash64("node"), F.col("n_all")).cast("int")
    firsts = rows_of.where("other").withColumn("i", i).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_all") - 1))).withColumn("first", F.lit(True))
    seconds = rows_of.withColumn("j", j).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_others") - 1))).withColumn("first", F.lit(False))
    columns = ["key", "i", "j", "node", "comp", "home", "other", "first"]
    met = firsts.select(columns).unionByName(seconds.select(columns))
    marks = scratch.save(held.groupBy("node").agg(F.collect_set("key").alias("groups"), F.collect_set(F.when(F.col("home"), F.col("key"))).alias("homes")))
    full = met.join(known.select("node", "sig"), "node").join(sets, "node").join(marks, "node")
    found = full.groupBy("key", "i", "j").applyInPandas(_blocks(positions, batch, percent / 100, miss, percent, 100), "a bigint, b bigint")
    return scratch.save(found.distinct())
