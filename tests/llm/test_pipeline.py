"""Each stage against what brute force would keep, and the whole pipeline on odd rows."""

import collections

import corpus_pipeline as cp
import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    leak = "thlyanble ntrely thea erouly at of ineranoror oferwhennt ther theslyor shea the reesanes instti"
    text = " ".join(f"w{i * 7 % 101}x{'abcdefgh'[i % 8]} the of and" for i in range(60))
    other = " ".join(f"ung{'klmnopqr'[i % 8]}keit der die und {'stuvw'[i % 5]}ein" for i in range(60))
    rows = [(1, text, "en", "src0", 9), (2, text + " end", "en", "src0", 9), (3, other, "de", "src1", 9), (4, f"{other[:300]} {leak.upper()} x", "de", "src1", 9)]
    rows += [(5, None, "en", "src0", 0), (6, "123 --", "en", "src0", 6), (None, "the of and w7xa with w3xb of the", None, None, None), (7, other[5:200] + leak[5:20], None, "unlisted", None), (3, other, "de", "src1", 9)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=repr)
    one = cp.language_id(spark, docs, folder)
    assert one.columns == docs.columns and ids(one) == sorted([1, 2, 3, 3, 4, 7, None], key=repr)
    two = cp.near_dedup(spark, one, folder)
    assert two.columns == docs.columns and ids(two) == sorted([1, 3, 3, 4, 7, None], key=repr)
    three = cp.decontamination(spark, two, folder)
    assert three.columns == docs.columns and ids(three) == sorted([1, 3, 3, 7, None], key=repr)
    four = cp.source_mix(spark, three, folder)
    assert four.columns == docs.columns
    five = cp.sharding(spark, four, folder).collect()
    assert collections.Counter(r["doc_id"] for r in five) == collections.Counter(ids(four))


def test_run_and_empty(spark, folder, tmp_path):
    assert {"shard", "slot"} < set(cp.run(spark, folder).columns)
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
