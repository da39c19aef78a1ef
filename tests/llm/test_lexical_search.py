import math
import re
from collections import Counter

import numpy as np

from gleanframe.llm import lexical_search
from tests.llm.oracle import assert_matches_sql

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    held = [(i, Counter(terms(x))) for i, x in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_words = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        got = []
        for i, c, n in held:
            m = 100 - 25 + 25 * n * n_docs // n_words
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c
            )
            if s > 0:
                got.append((s, i))
        got.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r, i, s) for r, (s, i) in enumerate(got[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, k=20, **options):
    d = spark.createDataFrame([(i, x, 1, "r") for i, x in docs], "doc_id long, text string, rank int, score string").repartition(3)
    b = spark.createDataFrame([(i, x, "q") for i, x in items], "item_id long, text string, query string").repartition(2)
    found = lexical_search.rank(d, b, k, **options)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted((tuple(r) for r in found.collect()), key=str)


def corpus(n, rng, topics=12):
    """Documents on a few topics, with some common words."""
    words = [[f"t{k}w{j}" for j in range(30)] for k in range(topics)] + [[f"all{j}" for j in range(8)]]
    out = []
    for i in range(n):
        topic = words[rng.integers(topics)]
        size = int(rng.integers(1, 60))
        out.append((i, " ".join(topic[min(29, int(rng.exponential(8)))] if rng.random() < 0.6 else words[-1][rng.integers(8)] for _ in range(size))))
    return out


def test_sql(spread):
    assert_matches_sql(spread, "op13_geometric_blocks", "/root/testdata/sf0.001")


def test_many_shards_and_blocks_of_items(spread, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD_ROWS", 60)
    monkeypatch.setattr(lexical_search, "BLOCK", 5)
    rng = np.random.default_rng(2)
    docs = corpus(700, rng)
    docs += [(i, docs[3][1]) for i in range(700, 900)]
    items = [(i, x) for i, x in corpus(12, rng)] + [(40, docs[3][1])]
    want = plain(docs, items, 20)
    assert run(spread, docs, items) == want
    assert run(spread, docs, items, block_terms=30) == want


def test_edges(spread):
    docs = [
        (1, "Alpha beta"), (1, "Alpha beta"), (2, None), (3, ""), (4, "..."), (None, "alpha"), (5, "ÄLPHA älpha Alpha_beta x9\u0080y"),
        (6, "beta " * 50_000), (7, "gamma"), (8, "gamma"), (8, "a" * 200_000),
    ]
    items = [(1, "ALPHA, alpha! Beta"), (1, "ALPHA, alpha! Beta"), (2, None), (3, ""), (None, "gamma gamma x9\u0080y"), (4, "nowhere"), (5, "äLPHA"), (6, "a" * 200_000)]
    for k in (1, 2, 20):
        assert run(spread, docs, items, k) == plain(docs, items, k)
    assert run(spread, [], items) == [] and run(spread, docs, []) == []
    assert run(spread, [(1, None)], items) == []
    # every document holds the word: its weight is small, or 0 in large tables
    assert run(spread, [(i, "same") for i in range(30)], [(1, "same")]) == plain([(i, "same") for i in range(30)], [(1, "same")], 20)


def test_shard_skips_but_loses_nothing():
    rng = np.random.default_rng(4)
    centres = rng.random((30, 200)) < 0.06
    rows = [np.flatnonzero(centres[rng.integers(30)] | (rng.random(200) < 0.01)) for _ in range(3000)]
    rows = [r if len(r) else np.array([0]) for r in rows]
    impacts = [rng.integers(1, 10**6, len(r)) for r in rows]
    shard = lexical_search.Shard(np.array([len(r) for r in rows]), np.concatenate(rows), np.concatenate(impacts), block=20)
    dense = np.zeros((3000, 200), np.int64)
    for d, (r, v) in enumerate(zip(rows, impacts)):
        dense[d, r] = v
    share = []
    for q in range(60):
        own = np.flatnonzero(centres[q % 30])
        weights = rng.integers(1, 9000, len(own))
        truth = dense[:, own] @ weights
        order = np.lexsort((np.arange(3000), -truth))[:10]
        docs, scores, taken = shard.search(own, weights, 0, 10)
        assert docs.tolist() == order.tolist() and scores.tolist() == truth[order].tolist()
        docs, scores, fewer = shard.search(own, weights, int(truth[order[4]]), 10)
        assert docs.tolist()[:5] == order[:5].tolist() and fewer <= taken
        share.append(taken / 3000)
    assert np.mean(share) < 0.2
    for term, blocks in shard.blocked.items():
        for b in range(len(blocks.starts) - 1):
            summary = np.zeros(200, np.int64)
            ends = [*blocks.summary_starts.tolist(), len(blocks.terms)]
            summary[shard.known[blocks.terms[ends[b] : ends[b + 1]]]] = blocks.values[ends[b] : ends[b + 1]]
            assert (summary == dense[blocks.docs[blocks.starts[b] : blocks.starts[b + 1]]].max(axis=0)).all()
