"""Joining a table of distinct words to the words of each document, without one row for every word.

Words are counted in each task first. The most frequent words of at most HEAD_BYTES bytes (a set of bounded size) are
broadcast, so the hot keys of the join are looked up where the text is; only
the other words become (document, word, frequency) rows, which are joined by a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct words (or byte strings) a task holds before it emits their counts, and their bytes.
FLUSH, FLUSH_BYTES = 300_000, 32 << 20
#: Frequent words broadcast at most, and how long such a word may be; longer ones are joined by the shuffle, however frequent.
HEAD, HEAD_BYTES = 1 << 18, 64


def word_counts(texts: DataFrame, lower: bool = False) -> DataFrame:
    """(word, c): occurrences of each distinct word in the one binary column of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        size = 0
        for batch in batches:
            for t in batch.column(0):
                t = t.as_py()
                size += len(t)
                held.update((t.lower() if lower else t).split())
                if len(held) >= FLUSH or size >= FLUSH_BYTES and (size := sum(map(len, held))) >= FLUSH_BYTES:
                    yield counted(held)
                    held, size = Counter(), 0
        if held:
            yield counted(held)

    return texts.mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def counted(held: Counter) -> pa.RecordBatch:
    words = sorted(held)  # sorted words compress well in the shuffle
    return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([held[w] for w in words], pa.int64())], names=["word", "c"])


def head_rows(vocabulary: DataFrame, value: str, limit: int) -> pa.Table:
    """(word, v): at most limit of the most frequent words of (word, c, value); any choice gives the same sums."""
    if dict(vocabulary.dtypes)["word"] == "binary":
        vocabulary = vocabulary.where(F.octet_length("word") <= HEAD_BYTES)
    n = vocabulary.count()
    least = vocabulary.select(F.percentile_approx("c", max(0.0, 1 - limit / n), 100_000)).first()[0] if n > limit else 0
    return vocabulary.where(F.col("c") > least).select("word", F.col(value).alias("v")).limit(limit).toArrow()


def head_of(vocabulary: DataFrame, value: str, limit: int = HEAD) -> dict[bytes, int]:
    """The frequent words' values, to be broadcast."""
    rows = head_rows(vocabulary, value, limit)
    return dict(zip(rows.column("word").to_pylist(), rows.column("v").to_pylist(), strict=True))


def own_key(row: int) -> bytes:
    """A join key that no word equals, as it holds a space; spreads the documents' own rows."""
    return b" %d" % row
