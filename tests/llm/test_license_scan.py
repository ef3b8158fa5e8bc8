"""Licence notices: base places against brute force, fuzzy notices against plain edit search."""

import random
import re

from pyspark.sql import functions as F

from horizonspark.llm.license_scan import BASE, FUZZY, Scanner, labels_of, license_hits

PHRASES = {n.text: n.label for n in BASE}


def brute(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), sorted(places)


def texts(n=200):
    r = random.Random(6)
    vocab = ["under", "the", "MIT", "license", "Apache", "version", "2", "2.0", "cc", "by-nc", "nc", "été", "Élan", "x", "licensed", "by"]
    out = [r.choice([" ", ", ", "\n"]).join(r.choice(vocab) for _ in range(r.randrange(60))) for _ in range(n)]
    out += ["Released under the MIT License. Under THE mit-license!", "under the mit license under the mit license", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "", None, "İunder the mit licenseÉ", "cc by nc", "cc by ncx", "(cc)by_nc"]
    return [*out, "word " * 200_000 + "under the mit license"]


def test_base_places(spark):
    rows = [(i, t, "h") for i, t in enumerate(texts())] + [(None, "cc by nc", None)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, hits string")
    out = docs.select("text", license_hits().alias("f")).select("text", "f.*").collect()
    assert len(out) == len(rows)
    for r in out:
        n, places = brute(r["text"])
        assert r["n_words"] == n
        assert sorted((h["first_word"], h["label"]) for h in r["hits"] if h["base"]) == places
        assert {x for _, x in places} <= {h["label"] for h in r["hits"]}
    assert docs.limit(0).select(license_hits().alias("f")).count() == 0


def test_fuzzy_notices():
    s = Scanner()
    found = lambda t: {(h[0], h[2]) for h in s.scan(t.encode())[1] if not h[1]}
    assert ("mit", 1) in found("released undr the MIT license")
    assert found("released under the BIT license") == set()
    assert ("gpl-3", 0) in found("This work is licensed under the GNU General Public License, version 3.")
    assert ("gpl-3", 2) in found("the GNU Generl Publc License version 3")
    assert found("apache license version 1") == set() and ("apache-2", 2) in found("Apach Licens, Version 2.0")
    assert ("all-rights-reserved", 1) in found("All right reserved") and found("allrounders") == set()
    assert found("licensed under cc by nd") == set()
    n, hits = s.scan("É, x All Rights\n Reserved. end".encode())
    assert n == 6 and [(h[3], h[6]) for h in hits] == [(2, "All Rights\n Reserved")]


def test_no_notice_within_its_edits_is_lost():
    r = random.Random(1)
    s = Scanner()
    for n in FUZZY:
        for _ in range(60):
            text = "".join(_edited(r, p, k) for p, k in n.parts)
            if " ".join(text.split()) == text:
                labels = {h[0] for h in s.scan(f"some words {text} and more".encode())[1]}
                assert n.label in labels, text


def _edited(r, part, k):
    b = list(part)
    for _ in range(r.randrange(k + 1)):
        inner = [i for i in range(1, len(b) - 1) if b[i] != " "]
        p = r.choice(inner)
        b[p] = r.choice(["z", "", b[p] + "q"])
    return "".join(b)


def test_labels_are_distinct_and_sorted(spark):
    docs = spark.createDataFrame([("under the mit license cc by nc under the mit license",), ("none",)], "text string")
    got = [r["l"] for r in docs.select(license_hits().alias("f")).select(labels_of(F.col("f.hits")).alias("l")).collect()]
    assert got == ["cc-by-nc,mit", ""]


def test_edited_notices_in_a_row():
    s = Scanner()
    hits = s.scan(b"all right reserved all rights reserved x")[1]
    assert [(h[3], h[2]) for h in hits] == [(0, 1), (3, 0)]
    r = random.Random(8)
    for _ in range(60):
        words, want = [], []
        for _ in range(r.randrange(2, 7)):
            words += ["x"] * r.randrange(3)
            want.append(len(words))
            words += r.choice(["all rights reserved", "all right reserved", "all rigts reservd", "al rights reserved", "all rights resxrved"]).split()
        text = " ".join(words)
        assert [h[3] for h in s.scan(text.encode())[1] if h[0] == "all-rights-reserved"] == want, text
