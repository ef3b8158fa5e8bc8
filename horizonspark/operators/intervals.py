"""Joins of intervals that overlap, by time bins as wide as the intervals are long.

An interval of a length below 2^k touches two bins of width 2^k at most. Its level is such a k, one of a few that stand four apart below the
greatest. A pair meets on the higher of its two levels, where each of both stands in two bins at most, by an equality of key, level and bin; so no side is
expanded into days or any other unit, and lengths may differ by any factor. A pair that shares two bins counts in the
first of them only.

Before that, each side is cut to the time from the other's first start to its last end: what lies outside meets nothing, and intervals that
reach far beyond the other side have no levels of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from horizonspark.sources.store import work_folder

#: Binary digits between two levels: each level costs a row for each row that looks there, each digit doubles the rows of a bin.
STEP = 4


def micros(time: Column) -> Column:
    """A timestamp as a number of microseconds, for spans."""
    return F.unix_micros(time.cast("timestamp"))


def _digits(start: Column, end: Column) -> Column:
    """The binary digits of the length; 0 for points."""
    return F.when(end == start, 0).otherwise(F.length(F.bin(end - start)))


def _level(digits: int, top: int) -> int:
    """The least level that holds lengths of so many digits: 0 for points, else one of top, top - STEP and so on."""
    return top - (top - digits) // STEP * STEP if digits else 0


def _in_bins(df: DataFrame, levels: Column) -> DataFrame:
    at = df.withColumn("_level", F.explode(levels))
    bin_of = lambda c: F.expr(f"shiftright({c}, _level)")
    return at.withColumn("_bin", F.explode(F.array_distinct(F.array(bin_of("_start"), bin_of("_end")))))


def interval_join(left: DataFrame, right: DataFrame, keys: dict[str, str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """(l, r): structs of each pair of rows whose closed spans (whole numbers) have a point in common, once for each pair of rows.

    keys maps key columns of left to equal ones of right; without any, only time counts. A point is a span that starts and ends at once.
    Spans that end before they start, and null spans or keys, match nothing. The first start, the last end and the lengths that occur (in digits, 64 at most)
    come to the driver; for that, what is left of the right side is written down, so that it is not made twice.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    spark = left.sparkSession

    def side(df: DataFrame, name: str, span: tuple[str, str], cols: list[str]) -> DataFrame:
        out = df.select(*[F.col(c).alias(n) for n, c in zip(names, cols, strict=True)], F.col(span[0]).cast("bigint").alias("_start"), F.col(span[1]).cast("bigint").alias("_end"), F.struct(*df.columns).alias(name))
        return out.where(" and ".join(["_start <= _end", *[f"{n} is not null" for n in names]]))

    def cut(df: DataFrame, first: int, last: int) -> DataFrame:
        inside = df.where((F.col("_start") <= last) & (F.col("_end") >= first))
        return inside.withColumns({"_start": F.greatest("_start", F.lit(first)), "_end": F.least("_end", F.lit(last))})

    def seen(df: DataFrame) -> tuple[int | None, int | None, list[int]]:
        return df.agg(F.min("_start"), F.max("_end"), F.collect_set(_digits(F.col("_start"), F.col("_end")))).first()

    a, b = side(left, "l", left_span, list(keys)), side(right, "r", right_span, list(keys.values()))
    first, last, left_digits = seen(a)
    if first is None:
        return a.join(b, F.lit(False)).select("l", "r")
    path = work_folder(spark, "spans")
    cut(b, first, last).write.parquet(path)
    b = spark.read.parquet(path)
    first, last, right_digits = seen(b)
    if first is None:
        return a.join(b, F.lit(False)).select("l", "r")
    whole = (last - first).bit_length()
    left_digits = {min(d, whole) for d in left_digits}
    top = max(*left_digits, *right_digits)
    levels = F.array(*[F.lit(_level(d, top)) for d in range(top + 1)])
    own = lambda most: F.element_at(levels, F.least(_digits(F.col("_start"), F.col("_end")), F.lit(most)) + 1)
    # what is cut from the left keeps the level of its length before, so that no levels come up that were not seen
    a, b = cut(a.withColumn("_own", own(whole)), first, last), b.withColumn("_own", own(top))
    left_levels, right_levels = (sorted({_level(d, top) for d in digits}) for digits in (left_digits, right_digits))

    def met(probing: DataFrame, standing: DataFrame, levels: list[int], least: Column) -> DataFrame:
        """Pairs on the level of `standing`, which is `least` or more."""
        held = F.filter(F.array(*[F.lit(k) for k in levels]), lambda k: k >= least)
        x, y = _in_bins(probing, held), _in_bins(standing, F.array("_own"))
        y = y.select(*names, "_level", "_bin", F.col("_start").alias("_start2"), F.col("_end").alias("_end2"), *[c for c in ("l", "r") if c in y.columns])
        pairs = x.join(y, [*names, "_level", "_bin"]).where("_start <= _end2 and _start2 <= _end and _bin = shiftright(greatest(_start, _start2), _level)")
        return pairs.select("l", "r")

    out = met(a, b, right_levels, F.col("_own"))
    if left_levels[-1] > right_levels[0]:
        out = out.unionByName(met(b, a, left_levels, F.col("_own") + 1))
    return out


def first_match(pairs: DataFrame, rows: list[str], priority: list[str], take: dict[str, str]) -> DataFrame:
    """For each left row (told by the columns `rows` of l): n_matches, and the columns take (of r) of its first match by priority (columns of r)."""
    best = F.min(F.struct(*[F.col(f"r.{c}").alias(f"p{i}") for i, c in enumerate(priority)], *[F.col(f"r.{c}").alias(f"t{i}") for i, c in enumerate(take)]))
    found = pairs.groupBy(*[F.col(f"l.{c}").alias(c) for c in rows]).agg(F.count("*").alias("n_matches"), best.alias("_best"))
    return found.select(*rows, "n_matches", *[F.col(f"_best.t{i}").alias(name) for i, name in enumerate(take.values())])
