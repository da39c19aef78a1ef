"""BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from gleanframe.llm import bpe
from gleanframe.llm.queries import QUERIES

PARTS = [
    "a", "B", " ", "  ", "\n", "\t", "<|endoftext|>", "'s", "'ll", "é", "1", "22", "!", "...", " ", "　", "\x1c", "\x85",
    "᠎", "​", "日本", "😀", "the", " the", "\r\n", "_", "-", "́", "ſ", "İ",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_same_ids_and_text_as_library(library):
    random.seed(3)
    own = bpe.BytePairs(bpe.default_vocabulary())
    for _ in range(5000):
        text = "".join(random.choice(PARTS) for _ in range(random.randint(0, 14)))
        ids = ids_of(library, text)
        coded = own.encode(text)
        assert np.frombuffer(coded, "<u4").tolist() == ids, text
        assert own.decode(coded) == library.decode(ids, skip_special_tokens=False)


def test_long_word_and_full_memo(library):
    own = bpe.BytePairs(bpe.default_vocabulary())
    small = bpe.UnitEncoder(own.encode_word, {"<|endoftext|>": 50256}, units=3, words=3)
    for text in ("ab" * 20000, " ".join(f"w{i}" for i in range(500)), "x" * 5000 + " y", "a b c d e f a b c d e f <|endoftext|> a\nb"):
        for encode in (own.encode, small.encode):
            assert np.frombuffer(encode(text), "<u4").tolist() == ids_of(library, text)
    assert len(small.later) + len(small.later.older) <= 6


def test_documents(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op8_bpe_round_trip"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = ids_of(library, d.text)
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_null_empty_repeated_and_clashing(spark):
    rows = [(None, None, 1), (1, "", 2), (2, "the cat", 3), (2, "the cat", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS int")
    out = bpe.decode(bpe.encode(df), text="back").collect()
    assert sorted((r.doc_id is None, r.doc_id, r.ids, r.back) for r in out if r.doc_id) == [
        (False, 1, [], ""), (False, 2, [1169, 3797], "the cat"), (False, 2, [1169, 3797], "the cat"),
    ]
    assert [r.back for r in out if r.doc_id is None] == [""]
    assert bpe.encode(df.limit(0)).count() == 0
    assert bpe.round_trip(df).filter("doc_id is null").first().n_tokens == 0
