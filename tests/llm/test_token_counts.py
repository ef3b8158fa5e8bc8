"""Token counts against the library on whole texts."""

import random
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from horizonspark.llm import token_counts as module
from horizonspark.llm import wordjoin
from horizonspark.llm.token_counts import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("limit", [1 << 18, 10])
def test_against_the_library(spark, limit, monkeypatch):
    monkeypatch.setattr(module, "head_of", lambda table, value: wordjoin.head_of(table, value, limit))
    r = random.Random(4)
    odd = ["", None, " \n\t ", "it's we'll they'VE", "a<|endoftext|>b <|startoftext|>", "<|endoftext|", "é ́x", "ÅNGSTRÖM Σίσυφος ΣΑΣ", "日本語 テキスト。🙂🙂", "x" * 40_000, " a b\x1cc\x85d", "12 345,6%%% ***", "İstanbul ǅ"]
    texts = odd + ["".join(r.choice("ab'sE é.\n<|>9́日🙂 ") for _ in range(r.randrange(400))) for _ in range(150)] + [" ".join(r.choice(["the", "of", "tionly", "Zzyzx"]) for _ in range(30_000))]
    rows = [(i if i % 7 else None, t, "n", b"w") for i, t in enumerate(texts)] + [(3, "same", "x", None)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n string, word binary")
    tok = Tokenizer.from_file(PATH)
    want = sorted(((d, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for d, t, *_ in rows), key=repr)
    definition = Path(PATH).read_text()
    assert sorted(map(tuple, token_counts(docs, definition).collect()), key=repr) == want
    assert token_counts(docs.limit(0), definition).count() == 0
