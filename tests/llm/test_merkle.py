"""The Merkle manifest against a plain tree in memory."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from horizonspark.llm.common import Scratch
from horizonspark.llm.merkle import build_manifest, document_manifest, folded, proofs

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, branch string, idx int, digest string, payload string, path string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """Levels of digests from the given ones to one."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 8])) for i in range(0, len(below), 8)])
    return levels


def plain_path(levels, at):
    path = []
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        path.append((run[: at % 8], run[at % 8 + 1 :]))
        at //= 8
    return path


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text); the query's rows."""
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0], plain_leaf(r), r))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        langs[name].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        trees[name] = plain_tree([x[2] for x in langs[name]])
    top = plain_tree([trees[n][-1][0] for n in names])
    out = []
    for k, name in enumerate(names):
        for at, (_, i, leaf, r) in enumerate(langs[name]):
            path = plain_path(trees[name], at) + plain_path(top, k)
            h = leaf
            if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and r[4] is not None:
                h = plain_leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in path:
                h = sha("".join([*left, h, *right]))
            out.append((i, leaf, trees[name][-1][0], top[-1][0], sha("".join(x for left, right in path for x in left + right)), h, h == top[-1][0]))
    return out


def documents(seed=3):
    r = random.Random(seed)
    rows = []
    for lang, n in [("en", 75), ("fr", 9), ("de", 8), ("", 2), ("é", 1), (None, 17), *[(f"l{i:02}", 1) for i in range(6)]]:
        for _ in range(n):
            rows.append((r.randrange(-5, 10_000), r.choice(["web", None, ""]), lang, r.choice([None, 5]), r.choice([None, "", "lower", "Été UPPER", "x" * r.randrange(300)])))
    rows += [(None, "web", "en", 1, "A"), (None, None, None, None, None), rows[0], rows[0], (rows[1][0], "other", "en", 1, "same ID"), (12, "s", "fr", 9, "Long " * 60_000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("some", [None, 1, 2, 9])
def test_manifest(spark, some):
    rows = documents()[:some]
    docs = spark.createDataFrame([(*r, "b", 1, "d", "p", "q") for r in rows], SCHEMA).repartition(5)
    got = document_manifest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_manifest(rows), key=repr)


def test_one_branch_and_nothing(spark):
    rows = [(i, None, "en", i, "T") for i in range(70)]
    docs = spark.createDataFrame([(*r, "b", 1, "d", "p", "q") for r in rows], SCHEMA)
    got = document_manifest(docs)
    assert sorted(map(tuple, got.collect())) == sorted(plain_manifest(rows))
    assert got.where("root <> subroot").count() == 0 and 0 < got.where("not verified").count() < 70
    assert document_manifest(docs.limit(0)).count() == 0


def test_any_changed_leaf_is_seen(spark):
    """Proofs of one store hold for its own leaves and for no others."""
    leaves = spark.range(600).select(F.concat(F.lit("b"), F.col("id") % 3).alias("branch"), F.col("id").alias("place"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.struct("id").alias("payload"))
    m = build_manifest(leaves, ["place"], Scratch(spark, "t"))
    told = proofs(m).select("payload.id", folded(F.col("digest"), F.col("path")).alias("own"), folded(F.sha2(F.concat("digest", F.lit("x")), 256), F.col("path")).alias("other"))
    assert told.where(F.col("own") == m.root).count() == 600 and told.where(F.col("other") == m.root).count() == 0
    assert [df.count() for df in m.levels] == [75, 12, 3] and m.subroots.count() == 3
