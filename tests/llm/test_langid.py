"""Language ID: held-out accuracy, and odd rows."""

import random

import zstandard

from horizonspark.llm.langid import Coder, held_out, identify, learn_dictionaries, letters

STEMS = {"aa": ["tion", "the", "ing", "and", "of"], "bb": ["keit", "ung", "der", "sch", "ein"], "cc": ["eaux", "ment", "que", "é", "oi"]}


def text(r, lang, n):
    return " ".join("".join(r.choice(STEMS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_odd_rows(spark):
    r = random.Random(2)
    rows = [(i, text(r, lang, r.randrange(3, 300)), lang, 0.5) for i, lang in enumerate(r.choice(list(STEMS)) for _ in range(600))]
    rows += [(1000, None, "aa", 0.1), (1001, "", "aa", 0.1), (1002, "12 _ ²!! 3", "bb", None), (None, text(r, "aa", 30), "aa", None), (1003, text(r, "bb", 200_000), None, None), (1004, text(r, "cc", 9), None, None), (1004, text(r, "cc", 9), None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")
    learned = learn_dictionaries(docs.where(~held_out()))
    assert set(learned) == set(STEMS) and all(len(x) <= 65_536 for x in learned.values())
    out = docs.select("doc_id", "lang", held_out().alias("held"), identify(docs, learned).alias("p")).collect()
    assert len(out) == len(rows)
    tested = [x for x in out if x["held"] and x["lang"] and x["p"]["lang_pred"] != "und"]
    assert len(tested) > 100 and sum(x["p"]["lang_pred"] == x["lang"] for x in tested) >= 0.98 * len(tested)
    assert all(0 <= x["p"]["score"] <= 1 for x in out)
    by = {x["doc_id"]: x["p"] for x in out}
    assert all(by[i]["lang_pred"] == "und" and by[i]["rejected"] for i in (1000, 1001, 1002))
    assert by[1003]["lang_pred"] == "bb" and by[1004]["lang_pred"] == "cc" and by[None]["lang_pred"] == "aa"
    assert not any(x["p"]["rejected"] for x in tested if x["p"]["lang_pred"] == x["lang"] and x["p"]["score"] > 0.01)


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id bigint, text string, lang string")
    learned = learn_dictionaries(docs)
    assert learned == {} and docs.select(identify(docs, learned).alias("p")).first()["p"]["lang_pred"] == "und"
    empty = docs.limit(0)
    assert empty.select(identify(empty, {"x": b"abc"}).alias("p")).count() == 0


def test_ties_and_single_language():
    assert Coder({"b": b"qqqq", "a": b"qqqq"}, 3, 64).classify(b"hello", 0.1) == ("a", 0.0, True)
    assert Coder({"a": b"some words here"}, 3, 64).classify(b"some words", 0.1)[0] == "a"


def test_letters():
    assert letters(b" Ab-c12_D! ") == b"ab c d" and letters(b"12 _") == b"" == letters("² ́ ½".encode())
    assert letters("Ab-c12_D! é".encode()) == "ab c d é".encode()
    assert letters("हिन्दी ก่อน".encode()) == "हिन्दी ก่อน".encode()  # marks belong to their words


def test_sizes_are_those_of_the_blocks():
    """Against compression done plainly: a short text and a short last block count as they are."""
    r = random.Random(4)
    learned = {lang: text(r, lang, 600).encode() for lang in STEMS}
    coder = Coder(learned, 6, 256)
    for n in (1, 3, 20, 90, 300):
        for lang in STEMS:
            words = letters(text(r, lang, n).encode())
            sizes = {}
            for k, d in learned.items():
                c = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
                sizes[k] = sum(len(c.compress(words[i : i + 256])) for i in range(0, len(words), 256))
            order = sorted(sizes.values())
            got = coder.classify(words, 0.002)
            assert got[0] == min(sorted(sizes), key=sizes.get) and abs(got[1] - (order[1] - order[0]) / order[1]) < 1e-12
