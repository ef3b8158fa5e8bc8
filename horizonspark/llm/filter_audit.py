"""Audit of how filters interact: all orders of applying them, from one pass of signed sums.

Which of k filters a row fails is a mask of k bits. For each part and label the 2^k signed parity sums
S(w) = sum over rows of (-1)^|mask & w| (the Walsh-Hadamard transform of the masks' counts) are aggregated; the transform is its own inverse
but for the factor 2^k, so the count of each mask comes back exactly, in integers. Every order of the filters, and each filter's Shapley
value (a row that fails f filters is removed by each of them in k! / f of the k! orders), then follows from the 2^k counts of a part,
whatever the number of rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from horizonspark.llm.common import Scratch, join_hot

FILTERS = "ABCDE"
#: A label of good and one of toxic documents; a row's label is their sum.
GOOD, TOXIC = 1, 2


def own_failures(text: Column) -> list[Column]:
    """Whether a text fails A to D: few words, few different ones, many capitals, a sign of markup or code."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * capitals > 3 * F.length(text), text.rlike(r"[#$%&*|]")]


def _bits(failures: list[Column], first: int = 0) -> Column:
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures, first)), F.lit(0))


def failure_masks(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask) of each row: bit i tells whether it fails filter i; the last, E, is equality with the text of any row of a smaller id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), _bits(own_failures(text)).alias("mask"))
    rows = scratch.save(rows)
    copied = scratch.save(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return join_hot(rows, copied, ["digest"], "n", "left").select("doc_id", "part", (F.col("mask") + F.when(later, 1 << 4).otherwise(0)).alias("mask"))


def labelled(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, label, mask, n): rows of the same id, part and mask are counted before they meet the labels, so no id is hot."""
    flag = lambda c, bit: F.max(F.when(F.col(c) == 1, bit).otherwise(0))
    told = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("doc_id")).agg((flag("quality", GOOD) + flag("toxic", TOXIC)).alias("label"))
    counted = masks.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    return counted.join(told, "doc_id", "left").select("part", F.coalesce("label", F.lit(0)).alias("label"), "mask", "n")


def _sign(mask: Column, w: Column | int) -> Column:
    return 1 - 2 * (F.bit_count(mask.bitwiseAND(w)) % 2)


def parity_sums(rows: DataFrame, k: int) -> DataFrame:
    """(part, label, sums): the 2^k signed sums of (part, label, mask, n), in order of w."""
    return rows.groupBy("part", "label").agg(F.array(*[F.sum(F.col("n") * _sign(F.col("mask"), F.lit(w))) for w in range(1 << k)]).alias("sums"))


def mask_cells(sums: DataFrame, k: int) -> DataFrame:
    """(part, label, mask, n): each mask's count, from the signed sums."""
    both = F.transform("sums", lambda s, w: s * _sign(F.col("mask"), w.cast("int")))
    count = F.aggregate(both, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return sums.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << k) - 1)))).select("part", "label", "mask", F.shiftright(count, k).alias("n"))


def _total(cells: Column, what: str, keep) -> Column:
    return F.aggregate(F.filter(cells, lambda c: keep(c["mask"])), F.lit(0).cast("bigint"), lambda a, c: a + c[what])


def order_report(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: k rows for each order of the filters and part."""
    k = len(filters)
    labelled_as = lambda bit: F.sum(F.when(F.col("label").bitwiseAND(bit) != 0, F.col("n")).otherwise(0))
    merged = cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), labelled_as(GOOD).alias("good"), labelled_as(TOXIC).alias("toxic"))
    parts = merged.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = ",".join("".join(p) for p in permutations(filters))
    steps = parts.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    place = {f: F.instr("filter_order", f) for f in filters}
    own = sum(F.when(place[f] == F.col("step"), 1 << i).otherwise(0) for i, f in enumerate(filters))
    before = sum(F.when(place[f] < F.col("step"), 1 << i).otherwise(0) for i, f in enumerate(filters))
    steps = steps.withColumns({"own": own, "before": before})
    held, own, before = F.col("cells"), F.col("own"), F.col("before")
    gone = lambda m: (m.bitwiseAND(before) == 0) & (m.bitwiseAND(own) != 0)
    share = F.aggregate(F.filter(held, lambda c: c["mask"].bitwiseAND(own) != 0), F.lit(0).cast("bigint"), lambda a, c: a + c["n"] * F.floor(factorial(k) / F.bit_count(c["mask"])))
    return steps.select(
        "part", "filter_order", "step",
        _total(held, "n", lambda m: m.bitwiseAND(before + own) == 0).alias("kept"),
        _total(held, "n", gone).alias("removed"),
        _total(held, "n", lambda m: (m.bitwiseAND(before) != 0) & (m.bitwiseAND(own) != 0)).alias("redundant"),
        _total(held, "n", lambda m: m == own).alias("unique_fails"),
        _total(held, "good", gone).alias("good_lost"),
        _total(held, "toxic", gone).alias("toxic_lost"),
        share.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """order_report of the five filters over documents (doc_id, text, lang) by lang, with labels (doc_id, quality, toxic).

    A null text is empty, and a null lang is the part of the empty string. Texts are read whole, whatever their length. Rows with a null id fail E never, make
    no other row fail it, and have no label; rows that repeat an id do not make each other fail E, and share that
    id's labels. Of several label rows of an id any that says 1 counts; labels of unknown ids, and nulls, do not. Empty documents give no rows; other columns are ignored, whatever
    their names.
    """
    scratch = Scratch(docs.sparkSession, "filter-audit")
    k = len(FILTERS)
    sums = scratch.save(parity_sums(labelled(failure_masks(docs, scratch), labels), k))
    return order_report(mask_cells(sums, k))


#: The same as SQL, by following each document through each order.
SQL = """
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
    g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT w.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                 [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS fails
          FROM w LEFT JOIN g ON g.doc_id = w.doc_id),
    l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    r AS (SELECT part, good, toxic, fails, filter_order, list_transform(string_split(filter_order, ''), lambda x: fails[ascii(x) - 64]) AS seq FROM f, o),
    p AS (SELECT *, list_position(seq, true) AS out_at, list_count(list_filter(fails, lambda x: CASE WHEN x THEN 1 END)) AS n_fails FROM r),
    s AS (SELECT *, unnest(range(1, 6))::INTEGER AS step FROM p),
    c AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS x, count(*) FILTER (coalesce(out_at, 6) > step OR out_at = 0) AS kept, count(*) FILTER (out_at = step) AS removed,
                 count(*) FILTER (seq[step] AND out_at < step) AS redundant, count(*) FILTER (seq[step] AND n_fails = 1) AS unique_fails,
                 count(*) FILTER (out_at = step AND good) AS good_lost, count(*) FILTER (out_at = step AND toxic) AS toxic_lost FROM s GROUP BY ALL)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM c"""
