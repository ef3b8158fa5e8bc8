"""As-of joins: for each row the newest row of another table before it, and the oldest after it.

Both tables are put together, sorted once by key and time, and the nearest right row is carried along the sorted rows; so the work is a
shuffle and a sort of both, whatever their sizes, and nothing is broadcast or held as an array. Keys with more rows than a task should sort are
sorted in ranges of (key, time) instead, and what a range hands on to the next is one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from horizonspark.sources.store import work_folder

_AT, _SIDE, _ORDER, _LEFT, _RIGHT, _PART = "_asof_at", "_asof_side", "_asof_order", "_asof_left", "_asof_right", "_asof_part"


def _order(forward: bool) -> list[Column]:
    """Rows in the direction in which right rows are carried: right rows of the same time come first, so that they count."""
    of = lambda c: F.col(c).desc() if forward else F.col(c).asc()
    return [of(_AT), F.col(_SIDE).asc(), of(_ORDER)]


def _carried(keys: list[str], forward: bool) -> Column:
    window = Window.partitionBy(*keys).orderBy(*_order(forward)).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(_RIGHT, ignorenulls=True).over(window)


def _in_ranges(rows: DataFrame, keys: list[str], forward: bool) -> DataFrame:
    """rows with the carried right row as _asof_found, sorted in ranges that may cut a key anywhere."""
    tied = rows.withColumn("_asof_tie", F.monotonically_increasing_id())
    # written down, as it is read twice, and another sample would draw other ranges
    path = work_folder(rows.sparkSession, "asof")
    tied.repartitionByRange(*keys, *_order(forward), "_asof_tie").drop("_asof_tie").withColumn(_PART, F.spark_partition_id()).write.parquet(path)
    ranged = rows.sparkSession.read.parquet(path)
    rank = F.when(F.col(_SIDE) == 0, F.struct(_AT, _ORDER))
    nearest = (F.min_by if forward else F.max_by)(F.col(_RIGHT), rank)
    before = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as ranges and cut keys
    handed = ranged.groupBy(*keys, _PART).agg(nearest.alias("_asof_nearest")).select(*keys, _PART, F.last("_asof_nearest", ignorenulls=True).over(before).alias("_asof_before"))
    local = ranged.withColumn("_asof_found", _carried([*keys, _PART], forward))
    return local.join(F.broadcast(handed), [*keys, _PART]).withColumn("_asof_found", F.coalesce("_asof_found", "_asof_before")).drop("_asof_before", _PART)


def asof_join(
    left: DataFrame, right: DataFrame, keys: dict[str, str], on: tuple[str, str], take: list[str], order: list[str] = (), backward: str | None = "last", forward: str | None = None, rows_per_key: int = 2_000_000
) -> DataFrame:
    """Every row of left, with the nearest right row as a struct of the columns `take`, null where there is none.

    keys maps key columns of left to those of right (none: all rows are one key), on names the time columns. The column `backward` gets the newest right
    row at or before the left row's time, `forward` the oldest at or after it; either may be None. Of right rows of the same time the one
    that is last by `order` counts backward, and the first forward. Null keys and times match nothing; rows of left that have them stay. Repeated
    rows of left are each answered. Keys with more than rows_per_key rows, of which there are few, are sorted in ranges.
    """
    names = [f"_asof_key{i}" for i in range(len(keys))]
    there = lambda df, cols: reduce(lambda a, b: a & b, [df[c].isNotNull() for c in cols])
    usable = there(left, [*keys, on[0]])
    lefts = left.where(usable).select(*[F.col(k).alias(n) for n, k in zip(names, keys, strict=True)], F.col(on[0]).alias(_AT), F.struct(*left.columns).alias(_LEFT))
    rights = right.where(there(right, [*keys.values(), on[1]])).select(
        *[F.col(k).alias(n) for n, k in zip(names, keys.values(), strict=True)], F.col(on[1]).alias(_AT), F.struct(*[F.col(c) for c in order] or [F.lit(0)]).alias(_ORDER), F.struct(*take).alias(_RIGHT)
    )
    wanted = [(name, f) for name, f in ((backward, False), (forward, True)) if name]

    def together(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.withColumn(_SIDE, F.lit(1)).unionByName(b.withColumn(_SIDE, F.lit(0)), allowMissingColumns=True)

    both = together(lefts, rights)
    hot = both.groupBy(*names).agg(F.count("*").alias("n")).where(F.col("n") > rows_per_key).drop("n")
    n_hot = hot.count()
    columns = [F.col(f"{_LEFT}.{c}").alias(c) for c in left.columns]
    parts = []
    if not n_hot or names:
        cold = both if not n_hot else both.join(F.broadcast(hot), names, "left_anti")
        carried = cold.select("*", *[_carried(names, f).alias(name) for name, f in wanted])
        parts.append(carried.where(F.col(_SIDE) == 1).select(*columns, *[name for name, _ in wanted]))
    if n_hot:
        some = (lambda df: df.join(F.broadcast(hot), names, "left_semi")) if names else (lambda df: df)
        held, own = some(lefts), some(rights)
        for name, f in wanted:
            found = _in_ranges(together(held, own), names, f).where(F.col(_SIDE) == 1)
            held = found.withColumnRenamed("_asof_found", name).drop(_SIDE, _ORDER, _RIGHT)
        parts.append(held.select(*columns, *[name for name, _ in wanted]))
    kind = dict(right.select(F.struct(*take).alias("s")).dtypes)["s"]
    parts.append(left.where(~usable).select(*left.columns, *[F.lit(None).cast(kind).alias(name) for name, _ in wanted]))
    return reduce(DataFrame.unionByName, parts)
