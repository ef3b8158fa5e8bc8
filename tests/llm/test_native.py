"""Sharding, exact dedup and mixing against brute force, with nulls, ties, repeats and empty tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from horizonspark.llm import sharding
from horizonspark.llm.chunk_dedup import chunks_of, exact_dedup
from horizonspark.llm.common import driver_rows, join_hot
from horizonspark.llm.mixing import mix_sources, poisson_cdf
from horizonspark.llm.sharding import _hypergeometric, communication_matrix, shard_uniform

SCHEMA = "doc_id bigint, text string, lang string, source string, recipe string, row string, shard int"


def rows():
    long = "Une phrase assez longue. " * 4000
    texts = ["a", "a", None, "", "x" * 5000, "x" * 5000, "x" * 4999, long, long + "!", "b.\nc", "B.\nc", "a"]
    out = [(i, t, None, f"s{i % 3}" if i % 5 else None, "r", "q", 9) for i, t in enumerate(texts)]
    return out + [(3, "", "en", "s0", None, None, None), (None, "a", None, None, None, None, None), (None, "only null", None, None, None, None, None)]


@pytest.mark.parametrize("hash_bits", [None, 2])
def test_exact_dedup(spark, hash_bits):
    docs = spark.createDataFrame(rows(), SCHEMA)
    kw = {} if hash_bits is None else {"chunk_hash": lambda c: F.pmod(F.xxhash64(c), F.lit(2**hash_bits))}
    got = sorted(map(tuple, exact_dedup(docs, **kw).drop("n_chunks").collect()), key=repr)
    groups = collections.defaultdict(list)
    for r in rows():
        groups[r[1] or ""].append(r[0])
    want = []
    for r in rows():
        g = groups[r[1] or ""]
        keep = max((i for i in g if i is not None), default=None)
        want.append((r[0], keep, len(g), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert exact_dedup(docs.limit(0)).count() == 0


def test_chunks_join_to_the_text(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    bad = docs.where(~F.concat_ws("", chunks_of(F.col("text"))).eqNullSafe(F.coalesce("text", F.lit(""))))
    assert bad.count() == 0


def test_edits_move_few_chunks(spark):
    text = " ".join(f"word{i * i % 977}{'.' if i % 9 == 0 else ''}" for i in range(9000))
    cut = lambda t: set(re.findall(r"(?s)(?:.{256,2048}?[\n.!?]|.{1,2048})", t))
    df = spark.createDataFrame([(text,), (text[:100] + "inserted" + text[100:],)], "text string").select(chunks_of(F.col("text")).alias("c"))
    a, b = (set(r["c"]) for r in df.collect())
    assert a == cut(text) and len(a - b) <= 2


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz  ", "0123456789abcdef", "абвгдежзийклмнопрстуфхцчшщ ", "".join(map(chr, range(0x4E00, 0x9FA5, 7)))])
def test_insertions_in_text_without_sentences(spark, alphabet):
    r = random.Random(1)
    text = "".join(r.choice(alphabet) for _ in range(60_000))
    other = text[:100] + "x" + text[100:30_000] + "yz" + text[30_000:]
    df = spark.createDataFrame([(text,), (other,)], "text string").select(chunks_of(F.col("text")).alias("c"))
    a, b = (r["c"] for r in df.collect())
    assert "".join(a) == text and "".join(b) == other and len(a) > 60 and len(set(a) - set(b)) <= 6


def test_join_hot(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id") % 40).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> 7")
    for how in ("inner", "left"):
        want = sorted(map(tuple, rows.join(groups, "k", how).select("k", "id", "n").collect()), key=repr)
        assert sorted(map(tuple, join_hot(rows, groups, ["k"], "n", how, limit=100).select("k", "id", "n").collect()), key=repr) == want
    assert join_hot(rows, groups.limit(0), ["k"], "n", "left").count() == 3000


def test_ranges_by_bytes(spark):
    docs = spark.createDataFrame(rows() * 4, SCHEMA).repartition(5)
    out = shard_uniform(docs, 3, seed=5, bytes_per_sort=100_000).collect()
    assert {s: sorted(r["slot"] for r in out if r["shard"] == s) for s in range(3)} == {s: list(range(20)) for s in range(3)}


def test_large_rates_and_null_ids(spark):
    docs = spark.range(4001).select(F.when(F.col("id") < 2000, F.col("id")).alias("doc_id"), F.when(F.col("id") == 0, "rare").otherwise("hot").alias("source"), F.col("id").cast("string").alias("text"))
    out = mix_sources(docs, {"rare": 1.0, "hot": 1.0})
    n = collections.Counter(r["source"] for r in out.select("source").collect())
    assert abs(n["rare"] - 2000) < 300 and abs(n["hot"] - 2000) < 300
    drawn = collections.Counter(r["text"] for r in out.where("doc_id is null").select("text").collect())
    assert 600 < len(drawn) < 1000 and max(drawn.values()) > 1  # each by itself: about 0.39 of the 2001 are drawn
    keys = out.where("doc_id is null").select("shuffle_key", "text")
    assert keys.select("shuffle_key").distinct().count() == keys.count()
    cdf = poisson_cdf(500.0)
    assert abs(cdf[500] - 0.5119) < 1e-3 and abs(cdf[-1] - 1) < 1e-9


def test_matrix_has_exact_sums():
    rows, shards = [5, 0, 17, 9, 2], [11, 11, 11]
    m = communication_matrix(rows, shards, 1)
    assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).tolist() == shards and (m >= 0).all()
    assert communication_matrix([], shards, 1).shape == (0, 3)
    many = np.array([communication_matrix([8, 24], [16, 16], s)[0, 0] for s in range(3000)])
    assert abs(many.mean() - 4) < 0.1 and abs(many.var() - 8 * 0.25 * 24 / 31) < 0.15


def test_large_populations():
    rng = np.random.default_rng(0)
    x = np.array([_hypergeometric(6 * 10**9, 14 * 10**9, 10**6, rng) for _ in range(400)])
    assert abs(x.mean() - 300_000) < 100 and 350 < x.std() < 580


@pytest.mark.parametrize("per_sort", [500_000, 3])
def test_shards(spark, per_sort):
    docs = spark.createDataFrame(rows() * 4, SCHEMA).repartition(5)
    got = shard_uniform(docs, 7, seed=5, rows_per_sort=per_sort)
    assert set(got.columns) == set(docs.columns) | {"slot"}
    out = got.collect()
    sizes = collections.Counter(r["shard"] for r in out)
    assert len(out) == len(rows()) * 4 and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
    for s in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
    assert collections.Counter(repr(r["text"])[:50] for r in out) == collections.Counter(repr(r[1])[:50] for r in rows() * 4)
    assert shard_uniform(docs.limit(0), 7).count() == 0


def test_shuffle_is_uniform(spark):
    docs = spark.range(6000).repartition(6)
    out = shard_uniform(docs, 3, seed=9).collect()
    first = collections.Counter(r["shard"] for r in out if r["id"] < 2000)
    assert all(abs(v - 2000 / 3) < 90 for v in first.values())
    slots = np.array([r["slot"] for r in out if r["id"] < 2000])
    assert abs(slots.mean() - 1000) < 40


def test_neighbouring_partitions_are_independent(spark):
    """Where a partition's rows stand in their shards says nothing about the shards of the rows at the same places of the next one."""
    each, parts = 4000, 5
    docs = spark.range(each * parts, numPartitions=parts)
    out = {r["id"]: r for r in shard_uniform(docs, 2, seed=11).collect()}
    slot, shard = (np.array([[out[p * each + i][c] for i in range(each)] for p in range(parts)], float) for c in ("slot", "shard"))
    for a in (slot, shard):
        for b in (slot, shard):
            assert all(abs(np.corrcoef(a[p], b[p + 1])[0, 1]) < 0.07 for p in range(parts - 1))
    assert all(abs(np.corrcoef(slot[p], shard[p])[0, 1]) < 0.07 for p in range(parts))


def test_many_partitions_give_a_bounded_matrix(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PARTITIONS", 64)
    docs = spark.range(900, numPartitions=300)
    seen = []
    draw = sharding.communication_matrix
    monkeypatch.setattr(sharding, "communication_matrix", lambda rows, *a: seen.append(len(rows)) or draw(rows, *a))
    out = shard_uniform(docs, 7, seed=1)
    assert out.count() == 900 and seen == [64]
    assert "Python" not in out._jdf.queryExecution().toString()


def test_mix(spark):
    n = 9000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 6000, "hot").when(F.col("id") < 8500, "cool").otherwise("free").alias("source"), F.lit("x").alias("copy"), F.lit("y").alias("_source"), F.lit(1).alias("_U"))
    out = mix_sources(docs, {"hot": 1.0, "cool": 3.0, "absent": 5.0}, total=1.5)
    c = collections.Counter(r["source"] for r in out.collect())
    assert c["free"] == 500
    assert abs(c["hot"] - 1.5 * 8500 / 4) < 250 and abs(c["cool"] - 1.5 * 8500 * 3 / 4) < 400
    assert out.where("copy > n_copies or copy < 1").count() == 0
    again = mix_sources(docs.repartition(3), {"hot": 1.0, "cool": 3.0, "absent": 5.0}, total=1.5)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


def test_mix_edges(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = mix_sources(docs, {"s0": 1.0, "s1": 1.0})
    plain = [r for r in rows() if r[3] not in ("s0", "s1")]
    assert out.where("source is null or source = 's2'").count() == len(plain)
    assert mix_sources(docs.limit(0), {"s0": 1.0}).count() == 0
    assert mix_sources(docs, {}).count() == len(rows())
    cdf = poisson_cdf(2.5)
    assert abs(cdf[0] - np.exp(-2.5)) < 1e-12 and abs(cdf[-1] - 1) < 1e-12


def test_driver_rows(spark):
    rows = [("a\" '\\", [0.1, 1e-300, 1 / 3], 1), (None, [], None), ("b", None, 2)]
    schema = "s string, c array<double>, n bigint"
    plain = spark.createDataFrame(rows, schema)
    for limit in (1 << 20, 50, 0):
        got = driver_rows(spark, rows, schema, limit)
        assert got.dtypes == plain.dtypes and sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)
    assert driver_rows(spark, [], schema).count() == 0
