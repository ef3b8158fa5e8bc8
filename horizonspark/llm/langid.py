"""Language identification by compression with per-language zstandard raw-content dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from horizonspark.llm.common import text_bytes

UNKNOWN = "und"
_NO_WORD = regex.compile(r"[^\p{L}\p{M}]+")
_ASCII = bytes(c | 32 if 65 <= c & 0xDF <= 90 else 32 for c in range(256))
PREDICTION = "struct<lang_pred: string, score: double, rejected: boolean>"


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def letters(text: bytes) -> bytes:
    """Lower-cased words (letters and their combining marks) with single spaces; empty if there is no letter."""
    if text.isascii():
        return b" ".join(text.translate(_ASCII).split())
    t = _NO_WORD.sub(" ", text.decode("utf-8", "replace").lower()).strip()
    return t.encode() if any(map(str.isalpha, t)) else b""


def learn_dictionaries(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 128, dictionary_bytes: int = 65_536, piece_bytes: int = 1_000) -> dict[str, bytes]:
    """For each language a raw-content dictionary from a bounded sample of its rows.

    The sample is the docs_per_language rows of least hashed id, at most piece_bytes
    from the middle of each, dictionary_bytes in all; so what reaches the driver is bounded by
    the number of languages. Rows with null language, text or id are not learned from.
    """
    rows = train.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("lang is not null and text is not null and id is not null")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = rows.select("lang", "id").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= docs_per_language)
    picked = rows.join(F.broadcast(ids.select("lang", "id").distinct()), ["lang", "id"], "left_semi")
    window = F.expr(f"substring(cast(text as binary), cast(greatest(1, (octet_length(text) - {4 * piece_bytes}) div 2) as int), {4 * piece_bytes})")
    parts: dict[str, list[bytes]] = {}
    sample = picked.groupBy("lang", "id").agg(F.min(window).alias("part")).orderBy("lang", F.xxhash64("id"), "id")
    for r in sample.collect():
        held = parts.setdefault(r["lang"], [])
        piece = letters(bytes(r["part"]))[:piece_bytes]
        if sum(map(len, held)) < dictionary_bytes:
            held.append(piece)
    return {k: b" ".join(v)[:dictionary_bytes] for k, v in sorted(parts.items()) if any(v)}


class Coder:
    """Encoded size of a text by each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int, block: int):
        self.block, self.by = block, {}
        for lang, content in dictionaries.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.by[lang] = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def classify(self, text: bytes, min_margin: float) -> tuple[str, float, bool]:
        """(language, score, rejected); the whole text counts, in blocks that each start from the dictionary."""
        words = letters(text)
        if not words or not self.by:
            return UNKNOWN, 0.0, True
        parts = [words[i : i + self.block] for i in range(0, len(words), self.block)]
        sizes = sorted((sum(len(c.compress(p)) for p in parts), lang) for lang, c in self.by.items())
        best, lang = sizes[0]
        second = sizes[1][0] if len(sizes) > 1 else best + len(words)
        score = min(1.0, max(0.0, (second - best) / second))
        return lang, score, score < min_margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", level: int = 6, block: int = 2048, min_margin: float = 0.002) -> Column:
    """A struct column for docs: lang_pred, score (relative margin to the second language, 0 to 1), rejected.

    A null text, one without letters, or any text if no language was learned is `und`, score 0, rejected;
    a margin below min_margin (near ties) is rejected too, but keeps its language. Of equal sizes the first language in
    alphabetical order is taken. Only the text is used.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    @F.pandas_udf(PREDICTION)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = Coder(shared.value, level, block)
        for texts in batches:
            yield pd.DataFrame([coder.classify(t, min_margin) for t in texts], columns=["lang_pred", "score", "rejected"]).astype({"score": "float64", "rejected": "bool"})

    return predict(text_bytes(text_col))
