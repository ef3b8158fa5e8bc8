"""Benchmark passages against brute force, with planted edits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from horizonspark.llm import decontam
from horizonspark.llm.decontam import CLASSES, Embedding, allowed, contaminated, decontaminate, edit_match, normal, normal_column, verified


def infix_distance(item, region):
    row = [0] * (len(region) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i]
        for j, d in enumerate(region, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d)))
    return min(row)


def words(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(n))


def edited(r, text, n):
    b = list(text)
    for _ in range(n):
        p, kind = r.randrange(len(b)), r.randrange(3)
        if kind == 0:
            b[p] = "z"
        elif kind == 1:
            del b[p]
        else:
            b.insert(p, "y")
    return "".join(b)


def test_edit_match_is_the_edit_distance():
    r = random.Random(3)
    for _ in range(150):
        item = "".join(r.choice("abc") for _ in range(r.randrange(1, 30))).encode()
        region = "".join(r.choice("abc") for _ in range(r.randrange(0, 50))).encode()
        want = infix_distance(item, region)
        m = edit_match(item, region, len(item))
        assert m[0] == want and infix_distance(item, region[: m[1]]) == want
        limit = allowed(len(item))
        if limit:
            v = verified(item, region)
            assert (v is not None) == (want <= limit) and (v is None or infix_distance(item, region[v[1] : v[2]]) == v[0] == want)


@pytest.mark.parametrize("length", [24, 35, 36, 47, 63, 64, 71, 72, 96, 150, 300])
def test_recall_of_the_keys(length):
    """At the largest allowed number of edits, 0.99 of the copies share a key with their item at the right place."""
    r = random.Random(length)
    number = [i for i, c in enumerate(CLASSES) if c.least <= length][-1]
    e = Embedding(number, 8)
    n, met = 400, 0
    for _ in range(n):
        item = normal(words(r, length)[:length].strip().ljust(length, "x").encode())
        copy = edited(r, item.decode(), allowed(len(item))).encode()
        before = normal(words(r, 9).encode()) + b" "
        text = np.frombuffer(before + copy + b" " + normal(words(r, 30).encode()), np.uint8)
        of_text = [set(k.tolist()) for k, _ in e.keys(text, np.arange(0, len(text), e.of.stride))]
        of_item = [set(k[end < len(item)].tolist()) for k, end in e.keys(np.frombuffer(item, np.uint8), np.arange(len(item)))]
        met += any(a & b for a, b in zip(of_text, of_item, strict=True))
    assert met >= 0.99 * n


def test_normal_forms_agree(spark):
    texts = [" A  b\tC\n\n\x0b\x0c\rd ", "", "Ä É İ ß ẞ  x", "  A b", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select("t", normal_column(F.col("t")).alias("n"))
    for x in df.collect():
        assert bytes(x["n"]) == normal(x["t"].encode())


def test_query_against_brute_force(spark):
    r = random.Random(5)
    items = [words(r, n) for n in (4, 6, 8, 10, 12, 15, 20, 25, 30, 45, 60)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rows = []
    for k in range(12):
        for i, t in enumerate(items):
            rows.append((len(rows), f"{words(r, 40)} {edited(r, t, allowed(len(t)) * (k % 4) // 2)} {words(r, 30)}"))
        rows.append((len(rows), words(r, 80)))
    got = {(x["doc_id"], x["item_id"]): x for x in contaminated(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), bench).collect()}
    want = {}
    for d, t in rows:
        for i, x in enumerate(items):
            m = edit_match(normal(x.encode()), normal(t.encode()), allowed(len(x)))  # the distance, as tested above
            if m:
                want[d, i] = m[0]
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want)
    text = dict(rows)
    for (d, i), x in got.items():
        assert x["edits"] == want[d, i] == edit_match(normal(items[i].encode()), normal(text[d].encode())[x["start"] : x["stop"]], x["edits"])[0]


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(spark, small, monkeypatch):
    if small:  # several passes, and joins by shuffles
        monkeypatch.setattr(decontam, "KEYS_A_PASS", 300)
        monkeypatch.setattr(decontam, "BROADCAST_KEYS", 0)
        monkeypatch.setattr(decontam, "BROADCAST_TEXTS", 0)
    r = random.Random(9)
    passages = [words(r, 20) for _ in range(5)]
    bench = spark.createDataFrame([(i, p) for i, p in enumerate(passages)] + [(7, None), (8, "short item"), (None, words(r, 20)), (9, passages[0]), (10, ""), (11, "x")], "item_id bigint, text string")
    long = words(r, 250_000) + " " + passages[3] + " end short item"
    rows = [(1, passages[0].upper().replace(" ", "\n\t"), None), (2, None, "x"), (3, "", "x"), (None, "a " + passages[1], "x"), (4, long, "x"), (5, words(r, 50), "x"), (5, passages[2], "x"), (5, passages[2], "x"), (6, edited(r, passages[4], 3), "x")]
    rows += [(12, "a Short\nITEM", "x"), (13, "a shorter item, short items xx x-ray", "x"), (14, "so X", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _text string")
    got = sorted(((h["doc_id"], h["item_id"]) for h in contaminated(docs, bench).collect()), key=repr)
    assert got == sorted([(1, 0), (1, 9), (None, 1), (4, 3), (4, 8), (5, 2), (5, 2), (6, 4), (12, 8), (14, 11)], key=repr)
    clean = decontaminate(docs, bench)
    assert clean.columns == docs.columns and sorted(x["doc_id"] for x in clean.collect()) == [2, 3, 5, 13]
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_common_openings(spark):
    """Openings that many items share propose nothing, and the items are still found; items that differ little keep all keys."""
    r = random.Random(4)
    opening, family = words(r, 12), words(r, 16)
    items = [(i, f"{opening} {words(r, 20)}") for i in range(200)] + [(1000 + i, f"{family} n{i}") for i in range(60)]
    docs = [(i, f"{words(r, 20)} {edited(r, t, 4)} {words(r, 20)}") for i, t in items[:20]] + [(500 + i, f"{words(r, 30)} {opening} {words(r, 30)}") for i in range(20)] + [(900, items[-1][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]) for x in contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()}
    assert got == {(i, i) for i in range(20)} | {(900, 1000 + i) for i in range(60)}
    from horizonspark.llm.common import Scratch

    named = spark.createDataFrame([(str(i).encode(), normal(t.encode())) for i, t in items], "item binary, item_text binary")
    keys = decontam._keys(named, Scratch(spark, "test"), 8).groupBy("key").agg(F.countDistinct("item").alias("n"), F.max("item").alias("i"))
    assert {x["i"][:2] for x in keys.where(F.col("n") > decontam.COMMON).collect()} == {b"10"}


def test_long_items(spark):
    r = random.Random(2)
    long = normal(words(r, 6_000).encode()).decode()
    docs = [(1, long[100:] + " tail"), (2, "start " + long[:20_000] + "zz" + long[20_001:]), (3, long[:5_000])]
    got = contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, long), (2, words(r, 20))], "item_id bigint, text string")).collect()
    assert sorted((x["doc_id"], x["item_id"], x["edits"]) for x in got) == [(1, 1, 100), (2, 1, 2)]
