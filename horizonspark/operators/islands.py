"""Gaps and islands: runs of rows that follow each other within a gap, for keys of any size or for all rows together.

Large keys, and all rows where there are none, are sorted in ranges of (key, place); each range finds its own islands, and what a range hands to the
next is one row. So no such key is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from horizonspark.sources.store import work_folder


def island_starts(rows: DataFrame, keys: list[str], at: str, gap: int = 1, rows_per_key: int = 2_000_000, width: int | None = None) -> DataFrame:
    """rows with island_start: the place `at` (a whole number) of the first row of the island that a row belongs to.

    A row belongs to the island of the row before it (of the same keys, nulls being a value) if it stands gap or less after it; rows at one place
    belong together. Rows without a place have no island. Keys of more than rows_per_key rows, and all rows if there are no keys, are sorted in ranges; other keys by themselves.
    Ranges are as wide as width; without it they are drawn from a sample, so that they hold about as many rows each, and the sorted rows are written down, as another
    sample would draw other ranges.
    """
    placed = rows.where(F.col(at).isNotNull())
    nowhere = rows.where(F.col(at).isNull()).withColumn("island_start", F.lit(None).cast("bigint"))
    if not keys:
        return _in_ranges(placed, [], at, gap, width).unionByName(nowhere)
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > rows_per_key).drop("_n")
    if sizes.isEmpty():
        return _local(placed, keys, at, gap).unionByName(nowhere)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    of = lambda how: placed.alias("a").join(F.broadcast(sizes).alias("b"), same, how).select("a.*")
    return _local(of("left_anti"), keys, at, gap).unionByName(_in_ranges(of("left_semi"), keys, at, gap, width)).unionByName(nowhere)


def _local(rows: DataFrame, keys: list[str], at: str, gap: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(at)
    before = F.lag(at).over(w)
    marked = rows.withColumn("_opens", F.when(before.isNull() | (F.col(at) - before > gap), F.col(at).cast("bigint")))
    return marked.withColumn("island_start", F.max("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def _handed(edges: Column, gap: int) -> Column:
    """For the ranges of a key in order: where the island that holds a range's first row started."""
    none = F.struct(F.array().cast("array<struct<part: int, start: bigint>>").alias("out"), F.lit(None).cast("bigint").alias("last"), F.lit(None).cast("bigint").alias("open"))

    def step(held: Column, e: Column) -> Column:
        start = F.when(e["first"] - held["last"] <= gap, held["open"]).otherwise(e["first"])
        return F.struct(F.concat(held["out"], F.array(F.struct(e["part"].alias("part"), start.alias("start")))).alias("out"), e["last"].alias("last"), F.when(e["open"] == e["first"], start).otherwise(e["open"]).alias("open"))

    return F.aggregate(edges, none, step, lambda held: held["out"])


def _ranged(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    path = work_folder(rows.sparkSession, "islands")
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    tied.repartitionByRange(*keys, at, "_tie").drop("_tie").withColumn("_part", F.spark_partition_id()).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _in_ranges(rows: DataFrame, keys: list[str], at: str, gap: int, width: int | None) -> DataFrame:
    ranged = rows.withColumn("_part", F.floor(F.col(at) / width).cast("int")) if width else _ranged(rows, keys, at)
    local = _local(ranged, [*keys, "_part"], at, gap)
    own = F.col("island_start")
    edges = local.groupBy(*keys, "_part").agg(F.min(at).cast("bigint").alias("first"), F.max(at).cast("bigint").alias("last"), F.max(own).alias("open"))
    # one row for each range, and for each cut key
    handed = edges.groupBy(*keys).agg(F.explode(_handed(F.array_sort(F.collect_list(F.struct(F.col("_part").alias("part"), "first", "last", "open"))), gap)).alias("h"))
    firsts = edges.select(*keys, "_part", "first")
    on = lambda a, b, more: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys] + more
    known = handed.alias("h1").join(firsts.alias("f1"), on("h1", "f1", [F.col("h1.h.part") == F.col("f1._part")])).select("f1.*", F.col("h1.h.start").alias("_start"))
    out = local.alias("l").join(F.broadcast(known).alias("k"), on("l", "k", [F.col("l._part") == F.col("k._part")]))
    start = F.when(F.col("l.island_start") == F.col("k.first"), F.col("k._start")).otherwise(F.col("l.island_start"))
    return out.select(*[F.col(f"l.{c}") for c in rows.columns], start.alias("island_start"))


def islands(rows: DataFrame, keys: list[str], at: str, gap: int = 1, rows_per_key: int = 2_000_000) -> DataFrame:
    """keys, island_start, island_end, n_rows: a row for each island."""
    found = island_starts(rows.select(*keys, at), keys, at, gap, rows_per_key).where("island_start is not null")
    return found.groupBy(*keys, "island_start").agg(F.max(at).cast("bigint").alias("island_end"), F.count("*").alias("n_rows"))
