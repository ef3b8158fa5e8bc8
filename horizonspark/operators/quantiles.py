"""Exact quantiles of keys of any size, by counting in ranges that get narrower.

percentile() holds all distinct values of a key in one buffer. Here the values that a wanted rank may be are counted in bins, the bin that
holds the rank is cut into bins again, and so on; a buffer holds no more than the counts of the bins. What is left, FEW values
at most or one repeated value, is sorted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values of a rank that are sorted rather than counted, and bins of a round.
FEW, BINS = 100_000, 4_096


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, probabilities: list[float], folder: str, few: int | None = None) -> DataFrame:
    """(keys, probability, quantile, n): linear interpolation between the two nearest ranks, as numpy's default and SQL's percentile_cont do.

    Nulls and NaN do not count; a key with nothing else has no rows. Null keys are a key of their own. Each round reads rows once, for keys of more than `few` values only, of which there
    are few; so their ranks are broadcast. The state of each round is written below folder.
    """
    few = FEW if few is None else few
    names = [f"_k{i}" for i in range(len(keys))]
    values = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    spark, n_saved = rows.sparkSession, 0
    root = f"{folder}/{uuid.uuid4().hex}"

    def saved(df: DataFrame) -> DataFrame:
        nonlocal n_saved
        n_saved += 1
        df.write.parquet(f"{root}/{n_saved}")
        return spark.read.schema(df.schema).parquet(f"{root}/{n_saved}")

    def of_key(a: str, b: str) -> list:
        return [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names] or [F.lit(True)]

    sizes = values.groupBy(*names).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n > 0")
    at = sizes.withColumn("p", F.explode(F.array(*map(F.lit, probabilities)))).withColumn("rank", F.col("p") * (F.col("n") - 1))
    ends = F.array_distinct(F.array(F.floor("rank").cast("bigint"), F.ceil("rank").cast("bigint")))
    wanted = at.select(*names, F.explode(ends).alias("r"), "lo", "hi", F.lit(0).cast("bigint").alias("below"), F.col("n").alias("inside")).distinct()
    state = saved(wanted)
    done = []
    while True:
        settled = (F.col("lo") == F.col("hi")) | (F.col("inside") <= few)
        done.append(state.where(settled))
        wide = state.where(~settled)
        if wide.isEmpty():
            break
        met = values.alias("x").join(F.broadcast(wide).alias("s"), [*of_key("x", "s"), F.col("v") >= F.col("lo"), F.col("v") <= F.col("hi")]).select("s.*", "v")
        bin_ = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS), F.lit(BINS - 1))
        counted = met.groupBy(*names, "r", "below", bin_.alias("bin")).agg(F.count("*").alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.coalesce(F.sum("inside").over(Window.partitionBy(*names, "r").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        state = saved(counted.withColumn("below", F.col("below") + before).where("below <= r and r < below + inside").select(state.columns))
    ranks = done[0]
    for df in done[1:]:
        ranks = ranks.unionByName(df)
    one = ranks.where("lo = hi").select(*names, "r", F.col("lo").alias("x"))
    left = ranks.where("lo < hi")
    met = values.alias("x").join(left.alias("s"), [*of_key("x", "s"), F.col("v") >= F.col("lo"), F.col("v") <= F.col("hi")]) if names else values.alias("x").join(F.broadcast(left).alias("s"), (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    placed = met.select("s.*", "v").withColumn("i", F.row_number().over(Window.partitionBy(*names, "r").orderBy("v")))
    found = saved(one.unionByName(placed.where(F.col("below") + F.col("i") - 1 == F.col("r")).select(*names, "r", F.col("v").alias("x"))))
    pair = lambda r, alias: found.withColumnsRenamed({"r": f"r{alias}", "x": f"x{alias}"}).alias(alias)
    joined = at.alias("t").join(pair("r", "a"), [*of_key("t", "a"), F.floor("rank") == F.col("ra")]).select("t.*", "xa").alias("t")
    joined = joined.join(pair("r", "b"), [*of_key("t", "b"), F.ceil("rank") == F.col("rb")]).select("t.*", "xb")
    part = F.col("rank") - F.floor("rank")
    return joined.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], F.col("p").alias("probability"), (F.col("xa") + (F.col("xb") - F.col("xa")) * part).alias("quantile"), "n")
