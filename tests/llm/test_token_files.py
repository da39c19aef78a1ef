"""Token files: exact round trips of the blocks, and the whole query against the library."""

import io
import zlib

import numpy as np
from tokenizers import Tokenizer

from gleanframe.llm import bpe, token_files as tf
from gleanframe.llm.queries import QUERIES
from gleanframe.session import scratch_path


def round_trip(docs):
    sink = io.BytesIO()
    w = tf.Writer(sink)
    for d, ids in docs:
        w.add(d, ids)
    w.close()
    return list(tf.read_documents(sink.getvalue())), len(sink.getvalue())


def test_blocks_give_back_every_id():
    rng = np.random.default_rng(5)
    makers = [
        lambda n: rng.integers(0, 50257, n), lambda n: np.full(n, 7), lambda n: rng.integers(0, 2**32, n),
        lambda n: np.where(rng.random(n) < 0.02, 2**32 - 1, rng.integers(100, 110, n)), lambda n: np.zeros(n),
    ]
    for make in makers:
        docs = [(i if i % 3 else None, make(n).astype(np.uint32)) for i, n in enumerate([1, 255, 256, 257, 3000, 1, 0, 300_000])]
        got, _ = round_trip(docs)
        assert [d for d, _ in got] == [d for d, _ in docs]
        for (_, a), (_, b) in zip(got, docs):
            assert np.array_equal(a, b)
    assert round_trip([])[0] == []


def test_outliers_do_not_widen_blocks():
    ids = np.random.default_rng(1).integers(0, 1000, 256 * 64).astype(np.uint32)
    ids[::100] = 50_000
    assert round_trip([(1, ids)])[1] < len(ids) * 1.6


def brute(docs):
    t = Tokenizer.from_file(bpe.default_vocabulary())
    out, at = [], 0
    for doc_id, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_documents(spread):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spread.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted(tuple(r) for r in QUERIES["op9_token_files"](spread, sf).collect())
    assert got == brute(docs)


def test_nulls_empty_repeats_small_files(spread):
    rows = [(None, "a b", 0), (5, None, 0), (5, "", 1), (3, "the cat", 2), (3, "the cat", 2), (9, "z " * 3000, 1)]
    df = spread.createDataFrame(rows, "doc_id long, text string, start int")
    manifest = tf.write(df, scratch_path(spread, "test-files"), file_ids=2)
    assert manifest.count() in (5, 6)  # the two single ids may share a file
    got = sorted((tuple(r) for r in tf.read(manifest).collect()), key=lambda r: r[1])
    assert got == brute([(None, "a b"), (3, "the cat"), (3, "the cat"), (5, None), (5, ""), (9, "z " * 3000)])
    assert tf.write_and_read(df.limit(0)).count() == 0
