"""Helpers shared by the training-data operators."""

from __future__ import annotations

import json
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(col: str | Column) -> Column:
    """UTF-8 bytes of a text, null as empty; Python workers take these without decoding."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def driver_rows(spark: SparkSession, rows: list[tuple], schema: str, literal_bytes: int = 1 << 20) -> DataFrame:
    """A table of rows that the driver holds, by a schema of names and types.

    It is a literal of the plan, or several of about literal_bytes each, so that no Python worker starts for it (createDataFrame takes two more in
    each executor, which stay).
    """
    names = [f.split()[0] for f in schema.split(", ")]
    kind = f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in schema.split(', '))}>>"
    texts, size = [[]], 0
    for r in rows:
        text = json.dumps(dict(zip(names, r, strict=True)))
        if size + len(text) > literal_bytes and texts[-1]:
            texts.append([])
            size = 0
        texts[-1].append(text)
        size += len(text)
    held = [spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(f"[{', '.join(part)}]"), kind, {"mode": "FAILFAST"}))) for part in texts]
    return reduce(DataFrame.union, held)


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner", limit: int = 1_000) -> DataFrame:
    """rows joined to groups, which has one row for each value of keys and in size how many rows have it.

    Rows of a key with more than limit rows, and more than a thousandth of all, are dealt to several tasks, each of which gets the group. So
    there are a thousand such keys at most; their hashes are broadcast.
    """
    n = groups.agg(F.sum(size)).first()[0] or 0
    limit = max(limit, -(-n // 1_000))
    h, parts, part = "_hot_hash", "_hot_parts", "_hot_part"
    hot = F.broadcast(groups.where(F.col(size) > limit).groupBy(F.xxhash64(*keys).alias(h)).agg(F.max(F.ceil(F.col(size) / limit)).alias(parts)))
    marked = [df.withColumn(h, F.xxhash64(*keys)).join(hot, h, "left").withColumn(parts, F.coalesce(parts, F.lit(1))) for df in (rows, groups)]
    dealt = marked[0].withColumn(part, F.pmod(F.monotonically_increasing_id(), F.col(parts))).drop(h, parts)
    copies = marked[1].withColumn(part, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(parts) - 1))).drop(h, parts)
    return dealt.join(copies, [*keys, part], how).drop(part)


class Scratch:
    """Tables written below the folder named by spark.checkpoint.dir.

    Written tables cut lineage and survive lost executors. Where the setting is unset, a local
    folder will do as long as the session is local (tests); on a cluster each executor would write to its own disk, so it is an error.
    The tables stay for the cluster's clean-up, as lazy results still read them.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.gettempdir()
        self.spark, self.root, self.n = spark, f"{root}/{name}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
