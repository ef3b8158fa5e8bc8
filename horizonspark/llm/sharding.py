"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

How many of each partition's rows go to each shard is drawn first, as a matrix
of small integers with the exact row and column sums of a uniformly random
permutation. Each partition then permutes its own rows and deals them out by its
row of the matrix; after the exchange each shard permutes what it received.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from horizonspark.llm.common import Scratch, driver_rows

#: numpy's own draws are limited to populations below this.
NUMPY_LIMIT = 10**9
#: Counts in the matrix at most, and input partitions; more partitions are read by fewer tasks.
CELLS, PARTITIONS = 4_000_000, 8_192
#: Between the seeds of the two drawn keys: rand() adds the partition's number to its seed, so nearer seeds would give neighbouring partitions the same numbers.
SEEDS_APART = 1 << 40


def _hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """One draw for any population: inversion outward from the mode."""
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    sd = math.sqrt(max(1.0, n * (good / (good + bad)) * (bad / (good + bad))))
    ks = np.arange(max(low, mode - int(12 * sd)), min(high, mode + int(12 * sd)) + 1)
    k = ks[:-1].astype(float)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(logs - logs.max())
    return int(ks[np.searchsorted(np.cumsum(p), rng.random() * p.sum())])


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Counts from each partition to each shard: sums over rows and columns are exact.

    Partitions are halved again and again; each half's share of every shard is a
    multivariate hypergeometric draw from what its parent holds.
    """
    rng = np.random.default_rng(seed)
    out = np.zeros((len(rows), len(shards)), dtype=np.int64)
    todo = [(0, len(rows), np.array(shards, dtype=np.int64))] if rows else []
    while todo:
        lo, hi, held = todo.pop()
        if hi - lo == 1:
            out[lo] = held
            continue
        mid = (lo + hi) // 2
        need, rest, left = int(sum(rows[lo:mid])), int(held.sum()), np.zeros_like(held)
        for i, c in enumerate(held):
            left[i] = _hypergeometric(int(c), rest - int(c), need, rng) if c and need else 0
            rest, need = rest - int(c), need - int(left[i])
        todo += [(lo, mid, left), (mid, hi, held - left)]
    return out


def _bytes(name: str, kind: str):
    """About what a column adds to a row."""
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(F.col(name)), F.lit(0)) + 8
    if kind.startswith("array"):
        return 16 * F.greatest(F.coalesce(F.size(F.col(name)), F.lit(0)), F.lit(0)) + 8
    return F.lit(16)


def shard_uniform(docs: DataFrame, n_shards: int, seed: int = 0, rows_per_sort: int = 500_000, bytes_per_sort: int = 16 << 20) -> DataFrame:
    """All columns of docs plus shard (0 to n_shards - 1) and slot (gapless from 0 in each shard).

    Shard sizes differ by one at most. Nulls, empty or long values and repeated
    rows are dealt like any others; an empty table gives an empty result. Columns
    named shard or slot in docs are replaced. The same input partitions and seed give the
    same result; the drawn keys are written down once, so lost executors cannot change them.
    The matrix has one row of n_shards counts for each partition, of which PARTITIONS are read at most: it does not grow with texts, and its size on the driver is bounded.
    A shard is sorted in ranges of about rows_per_sort rows and bytes_per_sort bytes at most, so that no task sorts a whole shard.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    drawn = docs.coalesce(max(64, min(PARTITIONS, CELLS // n_shards))).select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row") if kept else F.struct(F.lit(1)).alias("row"), F.rand(seed).alias("first"), F.rand(seed + SEEDS_APART).alias("second"))
    # local permutation: the row's place after sorting its partition by the drawn key
    placed = drawn.sortWithinPartitions("first").select("row", "second", F.monotonically_increasing_id().alias("at"))
    rows = scratch.save(placed.select("row", "second", F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("rank")))
    size = sum((_bytes(f"row.`{c}`", t) for c, t in docs.select(*[F.col(f"`{c}`") for c in kept]).dtypes), F.lit(16)).cast("bigint")
    held = rows.groupBy("part").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).collect()
    counts = sorted((r["part"], r["n"]) for r in held)
    total = sum(n for _, n in counts)
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([n for _, n in counts], sizes, seed)
    ends = [(part, [int(x) for x in np.cumsum(m)]) for (part, _), m in zip(counts, matrix, strict=True)]
    deal = driver_rows(spark, ends, "part int, ends array<bigint>")
    dealt = rows.join(F.broadcast(deal) if len(ends) * n_shards < 2_000_000 else deal, "part").select(
        "row", "second", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard")
    )
    # second permutation: within a shard by the other drawn key, in ranges
    sorts = max(total / n_shards / rows_per_sort, sum(r["bytes"] for r in held) / n_shards / bytes_per_sort)
    ranges = 1 << max(0, math.ceil(math.log2(max(1, sorts))))
    dealt = dealt.withColumn("range", F.floor(F.col("second") * ranges).cast("int"))
    ranked = dealt.withColumn("in_range", F.row_number().over(Window.partitionBy("shard", "range").orderBy("second")))
    out = [F.col(f"row.`{c}`").alias(c) for c in kept]
    if ranges == 1:
        return ranked.select(*out, "shard", (F.col("in_range") - 1).cast("bigint").alias("slot"))
    starts = rows.join(F.broadcast(deal) if len(ends) * n_shards < 2_000_000 else deal, "part").select(
        F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"), F.floor(F.col("second") * ranges).cast("int").alias("range")
    ).groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return ranked.join(starts, ["shard", "range"]).select(*out, "shard", (F.col("start") + F.col("in_range") - 1).cast("bigint").alias("slot"))
