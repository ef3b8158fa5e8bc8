"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horizonspark.llm.common import driver_rows, unused

#: A rate above this is drawn as a sum of so many equal parts that each stays below.
PART = 512.0


def poisson_cdf(rate: float, eps: float = 1e-15) -> list[float]:
    """P(X <= k) for k = 0, 1, ... until what is left is below eps; for rates up to 700, beyond which exp underflows."""
    p = cum = math.exp(-rate)
    out, k = [cum], 0
    while 1 - cum > eps and (k <= rate or p > eps):
        k += 1
        p *= rate / k
        cum += p
        out.append(cum)
    return out


def mix_sources(docs: DataFrame, weights: dict[str, float], total: float = 1.0, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Docs repeated so that each source's expected share of the rows is its weight's, in globally shuffled order.

    A source with n rows and weight w gets the mean repetition rate
    total * N * w / (sum of the weights present) / n, N being the rows of all weighted sources.
    A row's count inverts the Poisson distribution of that rate at a uniform number
    hashed from the seed and its id, so it depends on nothing else. A rate above PART is cut into equal parts, whose
    draws (each hashed from the part's number too) are summed up, so any rate is exact. Added columns:
    copy (1, 2, ...), n_copies, shuffle_key (the order of the rows). Rows of a null source or one
    without a weight stay once. A row with a null id is hashed by its whole content instead (its columns that have
    a hash: not maps), so such rows are drawn and spread by themselves, and equal ones alike; repeated rows
    are each repeated. Null and empty texts are rows like any other, and an empty table gives an empty result.
    Columns of these names in docs are replaced. The rate table has as many rows as weights, whatever the data.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in ("copy", "n_copies", "shuffle_key")]
    name, cdf, parts, number = (unused(docs, x) for x in ("_source", "_cdf", "_parts", "_number"))
    counts = {r["s"]: r["n"] for r in docs.where(F.col(source_col).isin(list(weights))).groupBy(F.col(source_col).alias("s")).agg(F.count("*").alias("n")).collect()}
    rows, share = sum(counts.values()), sum(weights[s] for s in counts)
    rates = {s: total * rows * weights[s] / share / n for s, n in counts.items() if share > 0}
    of = {s: max(1, math.ceil(r / PART)) for s, r in rates.items()}
    table = driver_rows(spark, [(s, poisson_cdf(r / of[s]), of[s]) for s, r in rates.items()], f"{name} string, {cdf} array<double>, {parts} int")
    content = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    own = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null-"), F.xxhash64(*content).cast("string")))
    n = F.when(F.col(cdf).isNull(), 1).otherwise(_draws(F.col(number), F.col(cdf), F.col(parts)))
    drawn = (
        docs.select(*[F.col(f"`{c}`") for c in kept], F.concat_ws(":", F.lit(seed), own).alias(number))
        .join(F.broadcast(table), F.col(source_col) == F.col(name), "left")
        .withColumn("n_copies", n.cast("bigint"))
        .where("n_copies > 0")
    )
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_copies"))))
    key = F.substring(F.md5(F.concat_ws(":", F.col(number), F.col("copy").cast("string"))), 1, 16)
    out = copies.select(*[F.col(f"`{c}`") for c in kept], "copy", "n_copies", key.alias("shuffle_key"))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def _draws(number, cdf, parts):
    """Sum of the parts' draws; the first part's hash is that of the number alone."""

    def draw(part):
        u = (F.conv(F.substring(F.md5(F.when(part == 0, number).otherwise(F.concat_ws("/", number, part.cast("string")))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
        return F.size(F.filter(cdf, lambda c: c < u)).cast("bigint")

    return F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0).cast("bigint"), lambda held, part: held + draw(part))
