import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.llm.bpe import TOKENIZER_DIR, byte_bpe, counter
from quillgrid.llm.encode import encode_corpus, with_token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(f"{TOKENIZER_DIR}/byte_bpe_50k.json"), reason="no vocabularies")

TEXTS = [
    "", " ", "\n", "Hello world", "it's  the <|endoftext|> end", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "\r\n\t x y　z", "栎岚芷旁边的bravease列使用什么单位？",
    "👍🏽 naïve ½ ² Ⅷ 12,345.67", "a" * 5000, "漢" * 3000, "ab" * 4000, "​﻿", "x" + " " * 700 + "y", "é" * 900 + "!?" * 600,
]


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def split(ids, counts):
    ends = np.cumsum(counts)
    return [ids[e - c : e].tolist() for e, c in zip(ends, counts)]


def test_equals_the_library():
    rng = random.Random(1)
    alphabet = "abcdefgh  \n.,'stl0123é漢👍-_<>"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(300)]
    assert split(*byte_bpe().encode(texts)) == library(texts)
    assert counter()(texts) == [len(x) for x in library(texts)]


def test_cache_may_be_emptied(monkeypatch):
    import quillgrid.llm.bpe as bpe

    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    b = byte_bpe()
    for t in TEXTS:
        assert split(*b.encode([t])) == library([t])


def test_null_empty_and_repeated_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = sorted((r["doc_id"] or -1, list(r["ids"])) for r in encode_corpus(df, "doc_id", "text").collect())
    a, c = library(["a b", "c"])
    assert got == [(-1, c), (1, a), (1, a), (2, []), (3, [])]
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    n = {r["doc_id"]: r["n_tokens"] for r in with_token_counts(df, "text", ["doc_id"]).collect()}
    assert n[2] == n[3] == 0 and n[1] == len(a)
