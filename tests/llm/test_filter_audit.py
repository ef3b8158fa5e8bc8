"""The filter audit against following every document through every order."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from horizonspark.llm.filter_audit import filter_audit, mask_cells, order_report, parity_sums


def plain_failures(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        e = i is not None and i > first[t]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": e}
        out.append((i, part or "", {f for f in fails if fails[f]}))
    return out


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs, parts = plain_failures(rows), sorted({p or "" for *_, p in rows})
    removed_by, found = Counter(), defaultdict(lambda: [0] * 6)
    for order in map("".join, permutations("ABCDE")):
        for i, part, fails in docs:
            gone = None
            for step, f in enumerate(order, 1):
                x = found[part, order, step]
                if f in fails:
                    x[3] += len(fails) == 1
                    if gone:
                        x[2] += 1
                    else:
                        gone = step
                        x[1] += 1
                        x[4] += i in good
                        x[5] += i in toxic
                        removed_by[part, f] += 1
                x[0] += not gone
    return [(part, order, step, *found[part, order, step], removed_by[part, order[step - 1]]) for part in parts for order in map("".join, permutations("ABCDE")) for step in range(1, 6)]


def documents():
    r = random.Random(2)
    rows = []
    for i in range(150):
        words = ["".join(r.choice("abcdE#é") for _ in range(r.randrange(1, 4))) if r.random() < 0.3 else r.choice(["w", "plain", "Word"]) + str(r.randrange(400)) for _ in range(r.choice([0, 3, 199, 200, 260]))]
        rows.append((r.randrange(-3, 200), r.choice([" ", "\n\t"]).join(words), r.choice(["en", "fr", None, ""])))
    rows += [(500, None, "en"), (None, None, "en"), (None, "", "fr"), (501, "a\x1cb\x0bA", "zz"), (499, rows[0][1], "en"), rows[3], (502, "w " * 100_000, "en"), (503, "100 words " * 100 + "x", None)]
    return rows


def test_against_plain_audit(spark):
    rows = documents()
    labels = [(i, q, t) for k, (i, *_) in enumerate(rows[:90]) for q, t in [((k % 2), int(k % 5 == 0))]] + [(rows[0][0], 1, 1), (None, 1, 1), (777, 1, 1), (499, None, 1), (500, 3, None)]
    docs = spark.createDataFrame([(*r, "m", "d", 2) for r in rows], "doc_id bigint, text string, lang string, mask string, digest string, label int").repartition(4)
    told = spark.createDataFrame([(*x, "t") for x in labels], "doc_id bigint, quality int, toxic int, text string")
    out = filter_audit(docs, told)
    assert [k for _, k in out.dtypes] == ["string", "string", "int"] + ["bigint"] * 7
    got, want = sorted(map(tuple, out.collect())), sorted(plain_audit(rows, labels))
    assert got == want and any(x[8] for x in want) and any(x[5] for x in want)
    assert filter_audit(docs.limit(0), told).count() == 0
    assert filter_audit(docs, told.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


@pytest.mark.parametrize("k", [1, 3, 5])
def test_inversion_is_exact(spark, k):
    rows = spark.range(5000).select(F.lit("p").alias("part"), (F.col("id") % 2).cast("int").alias("label"), (F.xxhash64("id") % (1 << k)).cast("int").alias("m"), F.col("id").alias("n"))
    rows = rows.select("part", "label", F.abs("m").alias("mask"), (F.col("n") * 1_000_000_007).alias("n"))
    want = {(r["label"], r["mask"]): r["n"] for r in rows.groupBy("label", "mask").agg(F.sum("n").alias("n")).collect()}
    got = {(r["label"], r["mask"]): r["n"] for r in mask_cells(parity_sums(rows, k), k).collect() if r["n"]}
    assert got == want


def test_other_filters(spark):
    cells = spark.createDataFrame([("p", 1, 0, 5), ("p", 0, 1, 3), ("p", 3, 2, 4), ("p", 0, 3, 7)], "part string, label int, mask int, n bigint")
    got = {(r["filter_order"], r["step"]): tuple(r)[3:] for r in order_report(cells, "XY").collect()}
    assert got == {("XY", 1): (9, 10, 0, 3, 0, 0, 13), ("XY", 2): (5, 4, 7, 4, 4, 4, 15), ("YX", 1): (8, 11, 0, 4, 4, 4, 15), ("YX", 2): (5, 3, 7, 3, 0, 0, 13)}
