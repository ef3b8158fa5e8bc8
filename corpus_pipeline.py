"""The corpus pipeline: language ID, near-dedup, decontamination, source mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's docs. run() applies all of them to documents.
SQL cannot express the compression, signature and embedding stages, so ORACLE_SQL is
None; the stages are tested against brute-force versions. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horizonspark.llm.common import Scratch, table, unused
from horizonspark.llm.decontam import decontaminate
from horizonspark.llm.langid import identify, learn_dictionaries
from horizonspark.llm.minhash import few_broadcast, near_duplicates
from horizonspark.llm.mixing import mix_sources
from horizonspark.llm.sharding import shard_uniform

N_SHARDS = 24
#: Rows of a batch that Spark hands to a Python worker. Rows hold whole texts, so Spark's default of 10,000 makes batches of tens of megabytes, several of which an executor holds at a time.
BATCH_ROWS = 1_000
MIX_WEIGHTS = {f"src{i}": 1.0 for i in range(20)}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's batches for Python workers to BATCH_ROWS rows; results do not depend on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what language ID rejects (null and empty texts and others without letters, and near ties between languages); gives rows without a lang the predicted one.

    Rows are judged one by one by their text, whatever their ids: repeated rows share their fate. With no labelled
    row to learn from, or none at all, nothing stays. Very long texts are judged whole.
    """
    small_batches(spark)
    learned = learn_dictionaries(docs)
    p = unused(docs, "_p")
    told = docs.withColumn(p, identify(docs, learned)).where(~F.col(p)["rejected"])
    return told.withColumn("lang", F.coalesce("lang", F.col(p)["lang_pred"])).drop(p)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near-duplicates (five-word shingles, similarity 0.8).

    Rows with a null id cannot be named as a group's member, so they stay; rows that
    repeat an id are one document and stay or go together. Null, empty and other texts without words link with nothing and stay; texts of any
    length are read whole. Other columns pass through, whatever their names. Ids of up to a million documents that go are broadcast, so that texts are not shuffled for them; more are joined by a shuffle.
    """
    small_batches(spark)
    found = near_duplicates(docs, shingle_words=5)
    gone = Scratch(spark, "near-dedup").save(found.where("doc_id is not null and not kept").select("doc_id").distinct())
    return docs.join(few_broadcast(gone), docs["doc_id"].cast("bigint") == gone["doc_id"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Null and empty texts hold none; rows with null or repeated ids are judged by their own text."""
    small_batches(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that the sources' shares follow MIX_WEIGHTS; rows in shuffled order. Rows of a null or other source stay once; texts play no part; see mix_sources for null ids."""
    return mix_sources(docs, MIX_WEIGHTS, seed="mix").select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot: a uniform shuffle into shards of equal size. Every row is dealt, whatever its values; an empty table gives an empty one."""
    return shard_uniform(docs, N_SHARDS, seed=3)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("sharding", sharding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.save(docs)
    return docs
