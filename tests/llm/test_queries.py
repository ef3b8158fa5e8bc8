"""The registered queries give their operators whole documents."""

from pyspark.sql import functions as F

from horizonspark.llm import queries
from horizonspark.llm.common import Scratch, table, text_bytes

SF = "/root/testdata/sf0.001"


def test_whole_documents_are_dealt_and_mixed(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    given, saved = [], []
    shard, mix, save = queries.shard_uniform, queries.mix_sources, Scratch.save
    monkeypatch.setattr(queries, "shard_uniform", lambda d, *a, **k: given.append(d.columns) or shard(d, *a, **k))
    monkeypatch.setattr(queries, "mix_sources", lambda d, *a, **k: given.append(d.columns) or mix(d, *a, **k))
    monkeypatch.setattr(Scratch, "save", lambda self, d: saved.append(save(self, d)) or saved[-1])
    out = queries.op3_hypergeometric_shards(spark, SF).select("doc_id", "size", "text_crc32")
    want = docs.select("doc_id", (F.octet_length(text_bytes("text")) + 8).cast("bigint").alias("size"), F.crc32(text_bytes("text")).alias("text_crc32"))
    assert sorted(out.collect()) == sorted(want.collect())
    saved.clear()
    rows = queries.op7_poisson_mix(spark, SF)
    assert given == [docs.columns] * 2
    assert rows.columns == ["doc_id", "source", "copy", "n_copies", "shuffle_key"]
    assert set(docs.columns) < set(saved[-1].columns) and saved[-1].select("doc_id", "text").exceptAll(docs.select("doc_id", "text").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(40)))).drop("n")).count() == 0
