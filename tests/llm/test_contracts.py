"""Each registered query on a small folder with odd rows, against brute force: columns, types, nulls, ties, repeats, empty tables, clashing names."""

import collections
import math
import random
import re
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from horizonspark.llm import queries
from tests.llm.test_filter_audit import plain_audit
from tests.llm.test_merkle import plain_manifest
from tests.llm.test_simhash import plain_components, plain_fingerprint

KINDS = {
    "op1_license_scan": "doc_id bigint,n_words bigint,n_base bigint,first_word bigint,last_word bigint,base_labels string,labels string,score double",
    "op2_ppm_score": "doc_id bigint,held_out boolean,n_tokens bigint,n_known bigint,train_tokens bigint,base_score double,score double",
    "op3_hypergeometric_shards": "doc_id bigint,size bigint,text_crc32 bigint,law string,shard int,slot bigint,grown_shard int",
    "op4_zstd_langid": "doc_id bigint,held_out boolean,lang_pred string,score double",
    "op5_chunk_recipe_dedup": "doc_id bigint,keep_id bigint,group_size bigint,kept boolean,text_sha256 string",
    "op6_pretoken_counts": "doc_id bigint,n_bytes bigint,n_tokens bigint,over_limit boolean",
    "op9_template_extraction": "page_id bigint,url string,text string,n_chars bigint",
    "op10_minhash_bayes": "doc_id bigint,n_shingles bigint,component_id bigint,kept boolean",
    "op11_simhash_multi_index": "doc_id bigint,fingerprint string,component_id bigint",
    "op12_merkle_manifest": "doc_id bigint,leaf string,subroot string,root string,proof_sha256 string,folded_root string,verified boolean",
    "op13_filter_audit": "part string,filter_order string,step int,kept bigint,removed bigint,redundant bigint,unique_fails bigint,good_lost bigint,toxic_lost bigint,shapley bigint",
}
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
LABELS = [(i, i % 2, i % 3, 7) for i in range(30)] + [(3, 1, 1, None), (None, 1, 1, None)]


def documents():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 5)))
    texts = [" ".join(word() for _ in range(r.randrange(1, 60))) for _ in range(40)]
    texts += [None, "", " \t\n", "12 _ ²!! 3", "Released UNDER the MIT-license.", "cc by nc cc-by-nc; Apache License, Version 2.0", "x" * 70_000, "mot " * 30_000, "A b\x0bC", "a b", "a", "Ⅷ 中文 字", "a b c d e f g h i j k"]
    texts += [t + " tail" for t in texts[:6]] + texts[:4]
    rows = [(i, t, ("aa", "bb", None)[i % 3], f"src{i % 4}", 1, "q", True, i if i % 4 else None) for i, t in enumerate(texts)]
    return rows + [(3, "repeated id " + texts[3], "aa", None, None, None, None, 3)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("contracts"))
    spark.createDataFrame(documents(), "doc_id bigint, text string, lang string, source string, slot int, component_id string, kept boolean, n_chars bigint").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, texts) for texts in ("a b c d e f g h i j k", "mot " * 20)], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    pages = [(1, "http://a.example/x", "<nav>m</nav><article><h1>T</h1><p>a\n &amp; b</p></article>", "x"), (2, None, None, "y"), (2, "odd", "", "y"), (3, "http://a.example/x", "<p>p</p>" * 3, None)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string, n_chars string").write.parquet(f"{sf}/pages.parquet")
    spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int, mask int").write.parquet(f"{sf}/labels.parquet")
    return sf


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "benchmark", "pages", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{sf}/{t}.parquet")
    return sf


@pytest.mark.parametrize("name", [n for n in queries.queries() if n != "pipeline"])
def test_columns_and_empty_tables(spark, folder, empty, name):
    got = dict(queries.queries()[name](spark, folder).dtypes)
    assert all(got[c.split()[0]] == c.split()[1] for c in KINDS.get(name, "").split(",") if c)
    assert queries.queries()[name](spark, empty).count() == 0


def rows_of(spark, folder, name):
    return [r.asDict() for r in queries.queries()[name](spark, folder).collect()]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def sorted_rows(rows):
    return sorted(rows, key=repr)


def test_op1(spark, folder):
    want = []
    for i, t, *_ in documents():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        at = [(k, label) for p, label in PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in at]
        want.append((i, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
    got = rows_of(spark, folder, "op1_license_scan")
    assert sorted_rows((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == sorted_rows(want)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert sum(bool(r["labels"]) for r in got) == sum(bool(x[5]) for x in want)  # nothing else is a notice


def test_op2(spark, folder):
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = collections.Counter(x for i, t, *_ in documents() if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted_rows((i, held(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens(t)), 4)) for i, t, *_ in documents())
    got = rows_of(spark, folder, "op2_ppm_score")
    assert sorted_rows((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_op3(spark, folder):
    got = rows_of(spark, folder, "op3_hypergeometric_shards")
    b = lambda t: (t or "").encode()
    assert sorted_rows((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted_rows((i, len(b(t)) + 8, zlib.crc32(b(t))) for i, t, *_ in documents())
    shards = collections.defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    n = [len(shards[s]) for s in range(24)]
    assert set(shards) <= set(range(24)) and max(n) - min(n) <= 1 and all(sorted(x) == list(range(len(x))) for x in shards.values())


def test_op4(spark, folder):
    got = rows_of(spark, folder, "op4_zstd_langid")
    assert sorted_rows((r["doc_id"], r["held_out"]) for r in got) == sorted_rows((i, zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in documents())
    text = collections.defaultdict(list)
    for i, t, *_ in documents():
        text[i].append(t)
    for r in got:
        und = all(not any(map(str.isalpha, t or "")) for t in text[r["doc_id"]])
        assert (r["lang_pred"] == "und") == und and r["lang_pred"] in ("aa", "bb", "und") and 0 <= r["score"] <= 1


def test_op6(spark, folder):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = [(i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in documents()]
    got = rows_of(spark, folder, "op6_pretoken_counts")
    assert sorted_rows((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == sorted_rows(want) and all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)


def test_op9(spark, folder):
    got = sorted_rows((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in rows_of(spark, folder, "op9_template_extraction"))
    assert got == sorted_rows([(1, "http://a.example/x", "T a & b", 7), (2, None, "", 0), (2, "odd", "", 0), (3, "http://a.example/x", "p p p", 5)])


def test_op10(spark, folder):
    docs = documents()
    sets = []
    for _, t, *_ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else set())
    root = {i: i for i, *_ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(docs)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = find(docs[x][0]), find(docs[y][0])
                root[max(a, b)] = min(a, b)
    want = [(i, len(s), find(i), find(i) == i) for (i, *_), s in zip(docs, sets, strict=True)]
    assert sorted_rows((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows_of(spark, folder, "op10_minhash_bayes")) == sorted_rows(want)


def test_op11(spark, folder):
    docs = documents()
    prints = [plain_fingerprint(t) for _, t, *_ in docs]
    comp = plain_components([(d[0], p) for d, p in zip(docs, prints, strict=True)])
    want = [(i, f"{p:016x}", comp[i]) for (i, *_), p in zip(docs, prints, strict=True)]
    assert sorted_rows((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows_of(spark, folder, "op11_simhash_multi_index")) == sorted_rows(want)


def test_op12(spark, folder):
    rows = [(i, source, lang, n_chars, t) for i, t, lang, source, _, _, _, n_chars in documents()]
    names = KINDS["op12_merkle_manifest"]
    assert sorted_rows(tuple(r[c.split()[0]] for c in names.split(",")) for r in rows_of(spark, folder, "op12_merkle_manifest")) == sorted_rows(plain_manifest(rows))


def test_op13(spark, folder):
    names = [c.split()[0] for c in KINDS["op13_filter_audit"].split(",")]
    want = plain_audit([d[:3] for d in documents()], [x[:3] for x in LABELS])
    assert sorted_rows(tuple(r[c] for c in names) for r in rows_of(spark, folder, "op13_filter_audit")) == sorted_rows(want)
