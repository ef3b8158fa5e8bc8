"""Near duplicates against a brute-force comparison of all pairs."""

import random

import numpy as np
import pytest

from horizonspark.llm import minhash
from horizonspark.llm.common import Scratch
from horizonspark.llm.minhash import least_matches, near_duplicates, prefix_lengths
from horizonspark.llm.shingles import shingle_sets


def brute(rows, k, percent=80):
    sets = {}
    for d, t in rows:
        if d is None:
            continue
        w = (t or "").encode().lower().split()
        sets.setdefault(d, []).append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    comp = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if comp[a] != comp[b] and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return comp


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(4):
        base = [r.choice(vocab) for _ in range(120)]
        for _ in range(n // 4):
            t = list(base)
            for _ in range(r.randrange(0, 14)):
                t[r.randrange(len(t))] = r.choice(vocab)
            rows.append(" ".join(t) if r.random() < 0.5 else "\n ".join(t).upper())
    rows += rows[:5] + ["", None, "one", "ONE", "one two", "été", "Été", " ".join(vocab * 30), " ".join([*vocab * 30, "x"])]
    r.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("k,seed,few,group,size", [(2, 1, 1, 64, 8 << 20), (5, 2, 16, 64, 8 << 20), (2, 3, 1, 2, 20_000)])
def test_against_brute_force(spark, k, seed, few, group, size, monkeypatch):
    monkeypatch.setattr(minhash, "ROWS", few)
    monkeypatch.setattr(minhash, "GROUP", group)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", size)
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "x", 1, b"") for d, t in rows], "doc_id bigint, text string, band string, node int, sig binary")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, shingle_words=k).collect()}
    assert got == brute(rows, k)


def test_nulls_repeats_and_nothing(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None), (2, "a b c d e"), (3, "a b c"), (None, None)], "doc_id bigint, text string")
    out = near_duplicates(docs, shingle_words=2).collect()
    assert len(out) == 7
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in out} == {(None, None, False), (1, 1, True), (2, 2, True), (3, 1, False)}
    assert near_duplicates(docs.limit(0)).count() == 0


def test_shingles_of_long_and_odd_texts():
    long = b"ab " * 900_000 + b"end"
    a, b, c, d = shingle_sets([long, b"x\ty\x0bz", b"  x y  z ", b"q" * 2_500_000 + b" r"], 2)
    assert len(a) == 2 and (b == c).all() and len(d) == 1
    assert [len(s) for s in shingle_sets([b"", b" ", b"one", b"a b a b a"], 2)] == [0, 0, 1, 2]
    whole = shingle_sets([b"p q r s t u"], 2)[0]
    assert np.isin(shingle_sets([b"q r s"], 2)[0], whole).all()


def test_posterior_bound():
    assert least_matches(32, 0.8, 1e-6) < 0.8 * 32 < 32
    rng = np.random.default_rng(0)
    lost = (rng.binomial(160, 0.8, 200_000) < least_matches(160, 0.8, 1e-6)).mean()
    assert lost < 1e-4


def test_prefixes_meet_every_linked_pair():
    r = random.Random(5)
    for _ in range(3000):
        y = r.sample(range(1000), r.randrange(1, 60))
        x = [v for v in y if r.random() > 0.12] + [1000 + i for i in range(r.randrange(0, 5))]
        x, y = sorted((sorted(x, key=lambda v: (v * 7919) % 1013), sorted(y, key=lambda v: (v * 7919) % 1013)), key=len)
        if x and 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y)):
            assert set(x[: prefix_lengths(len(x), 80, 100)[0]]) & set(y[: prefix_lengths(len(y), 80, 100)[1]])


def test_a_shared_template_is_not_compared(spark, monkeypatch):
    """Texts that share seven tenths meet in large buckets, but in no group of rare shingles; the few near copies among them are found."""
    r = random.Random(6)
    template = [f"t{i}" for i in range(140)]
    rows = [(i, " ".join(template + [f"u{i}x{j}" for j in range(60)])) for i in range(300)]
    rows += [(1000 + i, rows[i][1].replace(f"u{i}x{r.randrange(60)}", "edited")) for i in range(0, 300, 30)]
    compared = []
    verified, blocks = minhash._verified, minhash._compared_in_blocks
    monkeypatch.setattr(minhash, "_verified", lambda pairs, *a: compared.append(pairs.count()) or verified(pairs, *a))
    monkeypatch.setattr(minhash, "_compared_in_blocks", lambda *a: compared.append(10**9) or blocks(*a))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {d["doc_id"]: d["component_id"] for d in near_duplicates(docs, shingle_words=2).collect()}
    assert got == {i: i - 1000 if i >= 1000 else i for i, _ in rows}
    assert len(compared) == 3 and compared[-1] < 1000


@pytest.mark.parametrize("few,ids", [(10**6, 10**6), (0, 10**6), (0, 0)])
def test_components(spark, monkeypatch, few, ids):
    monkeypatch.setattr(minhash, "FEW_EDGES", few)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", ids)
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(-20, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(400, 400)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = minhash.components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "t")).collect()
    assert {x["node"]: x["comp"] for x in got} == {x: find(x) for x in root} and len(got) == len(root)
    assert minhash.components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark, "t")).count() == 0
