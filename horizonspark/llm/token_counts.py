"""Token counts: pieces once for each distinct pre-token, joined to the documents' pre-token frequencies.

A pre-token here is a run without ASCII white space. That is exact for tokenizers that
drop white space and never join across it, as the lower-casing word BPE does: a text's tokens are
its pre-tokens' tokens, special strings inside them included. No ids are kept.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horizonspark.llm.common import Scratch, text_bytes
from horizonspark.llm.wordjoin import head_of, own_key, word_counts


def _pieces(definition: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(definition)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                words = [w.decode("utf-8", "replace") for w in part.column(0).to_pylist()]
                n = [len(e) for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], names=["word", "c", "n"])

    return run


def _frequencies(head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, ids, sizes, sums, tail = part.column(0).to_pylist(), part.column(1), [], [], []
                for row, t in zip(rows, part.column(2), strict=True):
                    t, total = t.as_py(), 0
                    for w, f in Counter(t.split()).items():
                        n = known.get(w)
                        if n is None:
                            tail.append((w, row, f))
                        else:
                            total += n * f
                    sizes.append(len(t))
                    sums.append(total)
                tail.sort()
                none = pa.nulls(len(tail), pa.int64())
                columns = [
                    pa.array([w for w, _, _ in tail] + [own_key(r) for r in rows], pa.binary()),
                    pa.array([r for _, r, _ in tail] + rows, pa.int64()),
                    pa.array([f for _, _, f in tail] + [0] * len(rows), pa.int64()),
                    pa.concat_arrays([none, ids]),
                    pa.array([None] * len(tail) + sizes, pa.int64()),
                    pa.array([0] * len(tail) + sums, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "row", "f", "doc_id", "n_bytes", "part"])

    return run


def token_counts(docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    definition is the tokenizer's JSON. Null counts as empty (0 bytes, 0 tokens). Null and
    repeated ids are kept, a row each; other columns are ignored; an empty table gives an empty result.
    Whole texts of any length are counted, without truncation, padding or added special tokens.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-counts")
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text"))
    table = scratch.save(word_counts(src.select("text")).mapInArrow(_pieces(definition), "word binary, c bigint, n bigint"))
    head = spark.sparkContext.broadcast(head_of(table, "n"))
    found = src.mapInArrow(_frequencies(head), "word binary, row bigint, f bigint, doc_id bigint, n_bytes bigint, part bigint")
    joined = found.join(table.select("word", "n"), "word", "left")
    sums = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("part") + F.coalesce(F.col("f") * F.col("n"), F.lit(0))).alias("n_tokens")
    )
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
