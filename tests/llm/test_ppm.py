"""PPM scores against a slow statement of the model, and the unigram base against its formula."""

import collections
import math
import random
import zlib

import pytest

from horizonspark.llm.common import Scratch
from horizonspark.llm.ppm import END, START, gram_scores, held_out, score_documents


def slow_model(texts, order):
    counts = collections.defaultdict(collections.Counter)
    for t in texts:
        s = [START] * order + list(t) + [END]
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[bytes(s[i - k : i])][s[i]] += 1
    return counts


def slow_score(counts, text, order):
    s = [START] * order + list(text) + [END]
    out = 0.0
    for i in range(order, len(s)):
        excluded = set()
        for k in range(order, -1, -1):
            c = {x: n for x, n in counts.get(bytes(s[i - k : i]), {}).items() if x not in excluded}
            if not c:
                continue
            room = sum(c.values()) + len(c)
            if s[i] in c:
                out += math.log10(c[s[i]] / room)
                break
            out += math.log10(len(c) / room)
            excluded |= set(c)
        else:
            out -= math.log10(256 - len(excluded))
    return out


def rows(n=70):
    r = random.Random(8)
    vocab = ["The", "the", "of", "Élan", "keit", "tion,", "zz"]
    texts = [" ".join(r.choice(vocab) for _ in range(r.randrange(0, 40))) for _ in range(n)] + [None, "", " \n", "unseen ÿ日本 text", "x" * 5000]
    out = [(i, t, True, 1.0) for i, t in enumerate(texts)]
    return out + [(None, "the of", None, None), (3, "repeated id", None, None), (3, "repeated id", None, None)]


@pytest.mark.parametrize("order,words,grams", [(4, 1 << 18, 1 << 20), (5, 2, 30), (2, 1, 1)])
def test_against_slow_model(spark, order, words, grams):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id bigint, text string, held_out boolean, score double")
    got = sorted(map(tuple, score_documents(docs, ~held_out(), order=order, head_grams=grams, head_words=words).collect()), key=repr)
    out = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 5 == 1
    train = [(t or "").encode() for d, t, *_ in data if not out(d)]
    counts = slow_model(train, order)
    c = collections.Counter(w for t in train for w in [*t.lower().split(), None])
    n, v = sum(c.values()), len(c)
    want = []
    for d, t, *_ in data:
        b = (t or "").encode()
        tokens = [*b.lower().split(), None]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        want.append((d, out(d), len(tokens), sum(c[w] > 0 for w in tokens), n, base, slow_score(counts, b, order)))
    want.sort(key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_nothing_to_learn_from_and_nothing(spark):
    docs = spark.createDataFrame([(1, "ab", None)], "doc_id bigint, text string, x string")
    from pyspark.sql import functions as F

    r = score_documents(docs, F.lit(False)).first()
    assert (r["n_known"], r["train_tokens"], r["n_tokens"]) == (0, 0, 2) and r["score"] == pytest.approx(-3 * math.log10(256))
    assert score_documents(docs.limit(0), ~held_out()).count() == 0


def test_probabilities_add_up(spark):
    counts = collections.Counter()
    for t in (b"abracadabra", b"abra", b"cadabra"):
        s = bytes([START] * 2) + t + bytes([END])
        counts.update(int.from_bytes(s[i - 2 : i + 1], "big") for i in range(2, len(s)))
    contexts = [int.from_bytes(c, "big") for c in (b"ab", b"ra", b"zz", b"ca")]
    grams = set(counts) | {c << 8 | s for c in contexts for s in range(256)}
    table = spark.createDataFrame([(g, counts[g], 1) for g in grams], "gram bigint, c bigint, n bigint")
    found = {r["gram"]: r["lp"] for r in gram_scores(table, 2, Scratch(spark, "test")).collect()}
    assert set(found) == grams
    for c in contexts:
        assert sum(10 ** found[c << 8 | s] for s in range(256)) == pytest.approx(1)
