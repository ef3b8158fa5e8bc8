"""SimHash fingerprints and their links against a plain version over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from horizonspark.llm import simhash
from horizonspark.llm.common import Scratch
from horizonspark.llm.simhash import ball, fingerprint, hamming_links, midpoint_links, segments, simhash_duplicates


def plain_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, radius=4):
    """rows: (id, fingerprint); the smallest id reachable for each id."""
    comp = {i: i for i, _ in rows}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for x, (i, a) in enumerate(rows):
        for j, b in rows[:x]:
            if (a ^ b).bit_count() <= radius:
                p, q = find(i), find(j)
                comp[max(p, q)] = min(p, q)
    return {i: find(i) for i in comp}


def texts():
    r = random.Random(4)
    base = [" ".join(r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(400)) for _ in range(5)]
    out = [*base, *(t.replace(" ", "\n\t").upper() for t in base[:2]), None, "", " \x0b ", "one", "One two", "one two three", "one two three four", "é É", "a\x1cb c", "w " * 70_000, "x" * 600_000, base[0] + " tail"]
    for _ in range(40):
        words = r.choice(base).split()
        words[r.randrange(len(words))] = "edited"
        out.append(" ".join(words))
    return out


def test_fingerprints(monkeypatch):
    for t in texts():
        want = plain_fingerprint(t)
        for piece in (1 << 18, 7):
            monkeypatch.setattr(simhash, "PIECE", piece)
            if piece > 7 or len(t or "") < 10_000:
                assert fingerprint((t or "").encode()) % 2**64 == want


@pytest.mark.parametrize("n", [0, 1, 1000, 1 << 19, 1 << 22, 1 << 30, 1 << 40])
@pytest.mark.parametrize("radius", [0, 2, 4, 6])
def test_segments_meet_every_close_pair(n, radius):
    cut = segments(n, radius)
    rng = np.random.default_rng(n % 97 + radius)
    for _ in range(200):
        d = sum(1 << int(i) for i in rng.choice(64, radius, replace=False))
        assert any((d >> low & (1 << bits) - 1).bit_count() <= r for low, bits, r in cut)
    assert len(ball(16, 1)) == 17 and len(set(ball(64, 2))) == 2081


@pytest.mark.parametrize("hot", [1, 64])
def test_links_of_clusters(spark, monkeypatch, hot):
    """Chains, a crowd around one point and strangers; small limits send the crowd through midpoints."""
    monkeypatch.setattr(simhash, "HOT", hot)
    r = random.Random(hot)
    flip = lambda x, n: x ^ sum(1 << i for i in r.sample(range(64), n))
    values = {r.getrandbits(64) for _ in range(150)}
    centre = r.getrandbits(64)
    values |= {flip(centre, r.randrange(0, 5)) for _ in range(120)} | {flip(centre, 9) for _ in range(30)}
    x = r.getrandbits(64)
    for _ in range(25):
        values.add(x := flip(x, 4))
    rows = [(v - (1 << 64) if v >> 63 else v) for v in values]
    nodes = spark.createDataFrame([(v,) for v in rows], "fp bigint")
    links = [tuple(p) for p in hamming_links(nodes, 4, Scratch(spark, "t")).collect()]
    assert all(a < b and ((a ^ b) % 2**64).bit_count() <= 4 for a, b in links)
    root = {v: v for v in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    want = plain_components([(v, v % 2**64) for v in rows])
    assert {v: find(v) for v in rows} == want and len(set(want.values())) > 20


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 2)
    rows = [(7 * i % 101, t) for i, t in enumerate(texts())]
    rows += [(None, texts()[0]), (None, None), (rows[0][0], texts()[1]), rows[3]]
    docs = spark.createDataFrame([(i, t, "x", b"y", 1) for i, t in rows], "doc_id bigint, text string, fp string, key binary, n int")
    out = simhash_duplicates(docs)
    assert out.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint"), ("kept", "boolean")]
    want = plain_components([(i, plain_fingerprint(t)) for i, t in rows if i is not None])
    expected = [(i, f"{plain_fingerprint(t):016x}", want.get(i), i is not None and want[i] == i) for i, t in rows]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(expected, key=repr)
    assert simhash_duplicates(docs.limit(0)).count() == 0


def test_no_pairs_of_a_crowd(spark):
    """2,081 fingerprints within two bits of one: links grow with them, not with their pairs."""
    nodes = spark.createDataFrame([(m - (1 << 64) if m >> 63 else m,) for m in ball(64, 2)], "fp bigint")
    crowd, few = Scratch(spark, "t"), Scratch(spark, "t")
    assert midpoint_links(nodes, 4, crowd).count() == nodes.count() - 1
    assert midpoint_links(nodes.limit(0), 4, few).count() == 0


def test_odd_radius(spark):
    with pytest.raises(ValueError, match="even"):
        hamming_links(spark.range(3).select(F.col("id").alias("fp")), 3, Scratch(spark, "t"))
