"""Language-model scores by prediction by partial matching (PPM), pretrained on the corpus.

The model is a byte-context trie of contexts of up to `order` bytes. A byte that its
longest context hasn't seen escapes to the next shorter one (escape estimate C: as many
escapes as distinct followers), where the followers already ruled out are excluded;
below the empty context all other byte values are equally likely. A text is coded after
`order` start marks and ends with an end mark, so its score is the log10 probability of exactly this text.

A byte's probability depends on nothing but itself and the `order` bytes before it: one gram. So Spark
counts the grams of all training texts (those of shorter contexts are their suffixes), works out the
code length of every distinct gram of the corpus once, by joins of grams and contexts, and joins it to each
document's gram frequencies. No gram is left out, so the model grows with the corpus. The most
frequent grams, a set of bounded size, are broadcast and looked up where the text is; the others are joined by a
shuffle, along with the counts of rare tokens for the unigram base score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from horizonspark.llm.common import Scratch, text_bytes
from horizonspark.llm.wordjoin import FLUSH, FLUSH_BYTES, HEAD, head_of, head_rows, own_key

#: Neither byte occurs in UTF-8.
START, END = 0xFE, 0xFF
SYMBOLS = 256
_SLICE = 1 << 20
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Frequent grams broadcast at most (16 bytes each, and a table of places).
HEAD_GRAMS = 1 << 20
#: The gram of rows that stand for a word.
NO_GRAM = -1


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 1) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def _grams(stream: bytes, order: int) -> Iterator[tuple[int, np.ndarray]]:
    """(position of the first, keys) of the grams that end at each byte of the stream from `order` on, slice by slice."""
    b = np.frombuffer(stream, np.uint8)
    for lo in range(order, len(b), _SLICE):
        part = b[lo - order : lo + _SLICE].astype(np.uint64)
        n = len(part) - order
        keys = part[:n].copy()
        for i in range(1, order + 1):
            keys <<= np.uint64(8)
            keys |= part[i : i + n]
        yield lo, keys


def framed(texts: list[bytes], order: int) -> bytes:
    pad = bytes([START]) * order
    return b"".join([x for t in texts for x in (pad, t, bytes([END]))])


def _count(order: int):
    """From (held_out, text): (word, gram, c, n), c counting in training texts and n in all; rows are of a word (of training texts) or of a gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        size = read = 0

        def flush() -> pa.RecordBatch:
            w = sorted(words)
            g, c = _merged(grams)
            of_words = pa.array([words[x] for x in w], pa.int64())
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(w, pa.binary()), pa.nulls(len(g), pa.binary())]),
                    pa.concat_arrays([pa.nulls(len(w), pa.int64()), pa.array(g.view(np.int64))]),
                    pa.concat_arrays([of_words, pa.array(c[:, 0].copy())]),
                    pa.concat_arrays([of_words, pa.array(c[:, 1].copy())]),
                ],
                names=["word", "gram", "c", "n"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts: dict[bool, list[bytes]] = {False: [], True: []}
                for out, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    texts[out].append(t)
                for t in texts[False]:
                    read += len(t)
                    words.update(t.lower().split())
                for out, some in texts.items():
                    for _, keys in _grams(framed(some, order), order):
                        u, n = np.unique(keys[(keys & np.uint64(255)) != START], return_counts=True)
                        grams.append((u, np.stack([np.zeros_like(n) if out else n, n], axis=1)))
                        size += len(u)
                if size > 2 * FLUSH:
                    grams = [_merged(grams)]
                    size = len(grams[0][0])
                if read >= FLUSH_BYTES:
                    read = sum(map(len, words))
                if size >= 2 * FLUSH or len(words) >= FLUSH or read >= FLUSH_BYTES:
                    yield flush()
                    words, grams, size, read = Counter(), [], 0, 0
        if words or grams:
            yield flush()

    return run


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their rows of counts (two columns)."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
    k, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first, axis=0) if len(first) else c


class Table:
    """Places of distinct 64-bit keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys) - 1).bit_length() if len(keys) else 4)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.at = np.full(1 << bits, _EMPTY), np.full(1 << bits, -1, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot[todo]] == _EMPTY
            mine, first = np.unique(slot[todo][free], return_index=True)
            won = todo[free][first]
            self.keys[mine], self.at[mine] = keys[won], won
            left = np.ones(len(keys), dtype=bool)
            left[won] = False
            todo = todo[left[todo]]
            slot[todo] = np.where(self.keys[slot[todo]] == _EMPTY, slot[todo], (slot[todo] + 1) & self.mask)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, or -1."""
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.at[slot], np.int32(-1))
        open_ = np.flatnonzero((held != keys) & (held != _EMPTY))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            held = self.keys[slot]
            hit = held == keys[open_]
            out[open_[hit]] = self.at[slot[hit]]
            more = ~hit & (held != _EMPTY)
            open_, slot = open_[more], slot[more]
        return out


class Lookup:
    """Scores of texts from the code lengths of frequent grams, and the grams left to look up."""

    def __init__(self, keys: np.ndarray, log10: np.ndarray, order: int):
        self.places, self.log10, self.order = Table(keys), np.append(log10, 0.0), order

    def score(self, texts: list[bytes]) -> tuple[list[float], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """(sum of log10 probabilities of each text's known grams, other grams as (text, gram, frequency))."""
        out, others = [], []
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) < _SLICE):
                size += len(texts[stop]) + self.order + 1
                stop += 1
            part = texts[at:stop]
            ends = np.cumsum([len(t) + self.order + 1 for t in part])
            sums = np.zeros(len(part))
            for lo, keys in _grams(framed(part, self.order), self.order):
                real = np.flatnonzero((keys & np.uint64(255)) != START)
                keys, of = keys[real], np.searchsorted(ends, real + lo, "right")
                found = self.places.find(keys)
                sums += np.bincount(of, self.log10[found], len(part))
                miss = np.flatnonzero(found < 0)
                by = miss[np.lexsort((of[miss], keys[miss]))]
                k, o = keys[by], of[by]
                first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])) if len(k) else by
                others.append((o[first] + at, k[first], np.diff(np.append(first, len(k)))))
            out += sums.tolist()
            at = stop
        return out, others


def gram_scores(grams: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """(gram, n, lp) of every row of (gram, c, n): log10 probability of the gram's last byte after the others, learned from the counts c.

    Suffix sums give the counts of shorter grams; a context is summed up as total, followers and what its
    followers come to in the next shorter context. A gram seen in training needs its own context only. Any other
    walks down its suffixes; those of one and two bytes have at most 65,792 rows, so they are broadcast.
    """
    seen = grams.where("c > 0")
    suffixes = F.array(*[F.struct(F.lit(k).alias("k"), F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("key")) for k in range(order + 1)])
    counts = scratch.save(seen.select(F.explode(suffixes).alias("g"), "c").groupBy("g.k", "g.key").agg(F.sum("c").alias("c")))
    shorter = counts.select((F.col("k") + 1).alias("k"), F.col("key").alias("short_key"), F.col("c").alias("short_c"))
    both = counts.withColumn("short_key", F.expr("key & (shiftleft(1L, 8 * k) - 1)")).join(shorter, ["k", "short_key"], "left")
    contexts = scratch.save(
        both.groupBy("k", F.shiftright("key", 8).alias("context")).agg(F.sum("c").alias("total"), F.count("*").alias("followers"), F.sum(F.coalesce("short_c", F.lit(0))).alias("shorter_total"))
    )
    longest = contexts.where(F.col("k") == order).select("context", "total", "followers")
    direct = seen.withColumn("context", F.shiftright("gram", 8)).join(longest, "context").select("gram", "n", F.log10(F.col("c") / (F.col("total") + F.col("followers"))).alias("lp"))
    walks = grams.where("c = 0").select("gram", "n", F.explode(suffixes).alias("g")).select("gram", "n", "g.k", "g.key", F.shiftright("g.key", 8).alias("context"))
    short, long = (
        walks.where(cond).join(hint(counts.where(cond)), ["k", "key"], "left").join(hint(contexts.where(cond)), ["k", "context"], "left")
        for cond, hint in (("k <= 1", F.broadcast), ("k > 1", lambda df: df))
    )
    steps = short.unionByName(long).groupBy("gram").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("k", "c", "total", "followers", "shorter_total")), asc=False).alias("steps"))
    return direct.unionByName(steps.select("gram", "n", _walk(F.col("steps")).alias("lp")))


def _walk(steps: Column) -> Column:
    """log10 probability by the steps of one gram, longest context first: escape from each that has not seen it, without the followers ruled out."""

    def state(lp: Column, gone_total: Column, gone: Column, found: Column) -> Column:
        return F.struct(lp.alias("lp"), gone_total.alias("gone_total"), gone.alias("gone"), found.alias("found"))

    def step(held: Column, x: Column) -> Column:
        new = x["followers"] - held["gone"]
        room = (x["total"] - held["gone_total"] + new).cast("double")
        escaped = held["lp"] + F.when(new > 0, F.log10(new / room)).otherwise(0.0)
        return (
            F.when(held["found"] | x["total"].isNull(), held)
            .when(x["c"].isNotNull(), state(held["lp"] + F.log10(x["c"] / room), x["shorter_total"], x["followers"], F.lit(True)))
            .otherwise(state(escaped, x["shorter_total"], x["followers"], F.lit(False)))
        )

    start = state(F.lit(0.0), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.lit(False))
    return F.aggregate(steps, start, step, lambda held: F.when(held["found"], held["lp"]).otherwise(held["lp"] - F.log10(F.lit(SYMBOLS) - held["gone"])))


def _score(shared, head, constant: float, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = Lookup(*shared.value, order), head.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, texts = part.column(0).to_pylist(), part.column(3).to_pylist()
                tokens, base, n_known, tail = [], [], [], []
                for row, t in zip(rows, texts, strict=True):
                    n = s = k = 0
                    for w, f in Counter(t.lower().split()).items():
                        n += f
                        c = known.get(w)
                        if c is None:
                            tail.append((w, row, f))
                        else:
                            s += f * math.log10(c + 0.5)
                            k += f
                    tokens.append(n + 1)
                    base.append(s - (n + 1) * constant)
                    n_known.append(k)
                tail.sort()
                sums, others = model.score(texts)
                of, grams, often = (np.concatenate([o[i] for o in others]) for i in range(3))
                m, own = len(tail) + len(grams), len(rows)
                columns = [
                    pa.array([w for w, _, _ in tail] + [b""] * len(grams) + [own_key(r) for r in rows], pa.binary()),
                    pa.array(np.concatenate([np.full(len(tail), NO_GRAM), grams.view(np.int64), np.full(own, NO_GRAM)])),
                    pa.array(np.concatenate([np.array([r for _, r, _ in tail], np.int64), np.array(rows, np.int64)[of], np.array(rows, np.int64)])),
                    pa.array(np.concatenate([np.array([f for _, _, f in tail], np.int64), often.astype(np.int64), np.zeros(own, np.int64)])),
                    pa.concat_arrays([pa.nulls(m, pa.int64()), part.column(1)]),
                    pa.concat_arrays([pa.nulls(m, pa.bool_()), part.column(2)]),
                    pa.array([None] * m + tokens, pa.int64()),
                    pa.array([0] * m + n_known, pa.int64()),
                    pa.array([0.0] * m + base, pa.float64()),
                    pa.array([0.0] * m + sums, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "gram", "row", "f", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    return run


def score_documents(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 5, head_grams: int = HEAD_GRAMS, head_words: int = HEAD) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    training says which rows the model and the token counts learn from. Null counts as
    empty, whose score is that of the end mark. With nothing to learn from every byte
    value is equally likely, n_known is 0 and base_score is that of V = N = 0. Rows with null or
    repeated ids are kept, a row each; other columns are ignored; an empty table gives an empty result.
    order is 6 at most. head_grams and head_words bound what is broadcast; they do not change the result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ppm")
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), (~F.coalesce(training, F.lit(False))).alias("held_out"), text_bytes(text_col).alias("text"))
    counted = src.select("held_out", "text").mapInArrow(_count(order), "word binary, gram bigint, c bigint, n bigint")
    counts = scratch.save(counted.groupBy("word", "gram").agg(F.sum("c").alias("c"), F.sum("n").alias("n")))
    words = counts.where("gram is null").select("word", "c")
    sums = words.agg(F.sum("c"), F.count("*")).first()
    n_train = src.where("not held_out").count()
    total, distinct = (sums[0] or 0) + n_train, sums[1] + (n_train > 0)
    constant = math.log10(total + 0.5 * (distinct + 1))
    lengths = scratch.save(gram_scores(counts.where("gram is not null").select("gram", "c", "n"), order, scratch))
    top = head_rows(lengths.select(F.col("gram").alias("word"), F.col("n").alias("c"), "lp"), "lp", head_grams)
    known = (top.column("word").to_numpy().astype(np.uint64), top.column("v").to_numpy()) if top.num_rows else (np.zeros(0, np.uint64), np.zeros(0))
    model, head = spark.sparkContext.broadcast(known), spark.sparkContext.broadcast(head_of(words.withColumn("v", F.col("c")), "v", head_words))
    found = src.mapInArrow(
        _score(model, head, constant, order), "word binary, gram bigint, row bigint, f bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double"
    )
    values = words.select("word", F.lit(NO_GRAM).cast("bigint").alias("gram"), F.col("c").alias("n"), F.lit(None).cast("double").alias("lp")).unionByName(
        lengths.select(F.lit(b"").alias("word"), "gram", F.lit(None).cast("bigint").alias("n"), "lp")
    )
    joined = found.join(values, ["word", "gram"], "left")
    n, of_word = F.coalesce("n", F.lit(0)), F.col("gram") == NO_GRAM
    parts = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(n > 0, F.col("f")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(of_word, F.col("f") * F.log10(n + 0.5)).otherwise(0.0)).alias("base"),
        F.sum(F.col("score") + F.when(of_word, 0.0).otherwise(F.col("f") * F.col("lp"))).alias("score"),
    )
    end = 1 if n_train else 0
    return parts.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + end).cast("bigint").alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + math.log10(n_train + 0.5)).alias("base_score"), "score",
    )
