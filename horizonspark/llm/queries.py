"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pathlib import Path

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horizonspark.llm import filter_audit, merkle
from horizonspark.llm.chunk_dedup import exact_dedup
from horizonspark.llm.common import Scratch, table, text_bytes
from horizonspark.llm.decontam import contaminated
from horizonspark.llm.html_extract import extract_main_text
from horizonspark.llm.langid import held_out, identify, learn_dictionaries
from horizonspark.llm.license_scan import labels_of, license_hits
from horizonspark.llm.minhash import near_duplicates
from horizonspark.llm.mixing import mix_sources
from horizonspark.llm.ppm import held_out as ppm_held_out
from horizonspark.llm.ppm import score_documents
from horizonspark.llm.sharding import shard_uniform
from horizonspark.llm.simhash import simhash_duplicates
from horizonspark.llm.token_counts import token_counts

N_SHARDS = 24
#: Equal shares for the twenty sources of the corpus.
MIX_WEIGHTS = {f"src{i}": 1.0 for i in range(20)}


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", license_hits().alias("f")).select("doc_id", "f.n_words", "f.hits")
    base = F.filter("hits", lambda h: h["base"])
    firsts = F.transform(base, lambda h: h["first_word"])
    near = F.transform("hits", lambda h: 1 - h["edits"] / F.length(h["found"]))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"),
        labels_of(base).alias("base_labels"), labels_of(F.col("hits")).alias("labels"), F.coalesce(F.greatest(F.lit(0.0), F.array_max(near)), F.lit(0.0)).alias("score"),
    )


def op2_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), ~ppm_held_out())


def op3_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are dealt; size and checksum are those of the texts that arrive."""
    dealt = shard_uniform(table(spark, sf_dir, "documents"), N_SHARDS, seed=3)
    size = (F.octet_length(text_bytes("text")) + 8).cast("bigint")
    return dealt.select("doc_id", size.alias("size"), F.crc32(text_bytes("text")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_zstd_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = learn_dictionaries(docs.where(~held_out()))
    out = docs.select("doc_id", held_out().alias("held_out"), identify(docs, learned).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def op5_chunk_recipe_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    definition = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()
    return token_counts(table(spark, sf_dir, "documents"), definition)


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are mixed and written; without the table, Spark would leave the texts out of the shuffle, as the result has none."""
    mixed = Scratch(spark, "mix").save(mix_sources(table(spark, sf_dir, "documents"), MIX_WEIGHTS, seed="mix"))
    return mixed.select("doc_id", "source", "copy", "n_copies", "shuffle_key")


def op8_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_main_text(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))


def op10_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


def op11_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, seed=42, radius=4)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    ops = {f.__name__: f for f in (op1_license_scan, op2_ppm_score, op3_hypergeometric_shards, op4_zstd_langid, op5_chunk_recipe_dedup, op6_pretoken_counts, op7_poisson_mix, op8_cgk_decontamination, op9_template_extraction, op10_minhash_bayes, op11_simhash_multi_index, op12_merkle_manifest, op13_filter_audit)}
    return ops | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    names = ", ".join(f"('{s}', {w!r}::DOUBLE)" for s, w in MIX_WEIGHTS.items())
    return {
        "op5_chunk_recipe_dedup": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
                 g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
        "op7_poisson_mix": f"""
            WITH w(source, weight) AS (VALUES {names}),
                 n AS (SELECT source, weight, count(*) AS n FROM documents JOIN w USING (source) GROUP BY ALL),
                 r AS (SELECT source, (SELECT sum(n) FROM n) * weight / (SELECT sum(weight) FROM n) / n AS rate FROM n),
                 k AS (SELECT source, rate, unnest(range(0, 40)) AS k FROM r),
                 c AS (SELECT source, sum(exp(-rate) * pow(rate, k) / gamma(k + 1)) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
                 d AS (SELECT doc_id, source, (('0x' || substr(md5(concat_ws(':', 'mix', doc_id::VARCHAR)), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM documents),
                 m AS (SELECT doc_id, d.source, CASE WHEN (SELECT count(*) FROM r WHERE r.source = d.source) = 0 THEN 1
                              ELSE (SELECT count(*) FROM c WHERE c.source = d.source AND c.cdf < d.u) END AS n_copies FROM d),
                 e AS (SELECT doc_id, source, n_copies, unnest(range(1, n_copies + 1)) AS copy FROM m)
            SELECT doc_id, source, copy, n_copies, substr(md5(concat_ws(':', 'mix', doc_id::VARCHAR, copy::VARCHAR)), 1, 16) AS shuffle_key FROM e""",
        "op10_minhash_bayes": r"""
            WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
            s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
            n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
            l AS MATERIALIZED (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
            e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
            r(doc_id, low) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.low FROM r JOIN e ON e.x = r.doc_id AND r.low < e.y)
            SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.low) AS component_id, d.doc_id = min(r.low) AS kept FROM d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n""",
        "op12_merkle_manifest": merkle.SQL,
        "op13_filter_audit": filter_audit.SQL,
    }
