"""SimHash groups against all pairs, and components against a plain search."""

import random
import re

import pytest
import xxhash

from gleanframe.llm import simhash as S
from gleanframe.llm.components import connected_components
from gleanframe.llm.queries import QUERIES


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    """rows: (id, fingerprint); all pairs, smallest id, null last."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                parent[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best.setdefault(root(i), []).append(d)
    least = {r: min([d for d in ids if d is not None], default=None) for r, ids in best.items()}
    return [(d, f"{fp:016x}", least[root(i)]) for i, (d, fp) in enumerate(rows)]


def order(rows):
    return sorted(rows, key=str)


def test_documents(spread):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        docs = spread.read.parquet(f"{sf}/documents.parquet").collect()
        want = plain_components([(d.doc_id, plain_fingerprint(d.text)) for d in docs])
        assert order(map(tuple, QUERIES["op2_simhash_pigeonring"](spread, sf).collect())) == order(want)


def test_near_values_and_chains(spread):
    rng = random.Random(7)
    prints = [rng.getrandbits(64) for _ in range(20)]
    for base in prints[:6]:
        for _ in range(40):
            x = base
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            prints.append(x)
    step = prints[0]
    for k in range(0, 60, 2):  # a chain of links
        step ^= 3 << k
        prints.append(step)
    rows = [(i, p) for i, p in enumerate(prints)]
    signed = spread.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in rows], "id long, fp long")
    got = signed.join(S.groups(signed, "id", "fp"), "fp").select("id", "first.id").collect()
    assert sorted(map(tuple, got)) == sorted((i, c) for i, _, c in plain_components(rows))


def test_nulls_empty_repeats(spark):
    rows = [(None, None, 1), (4, "", 2), (3, "  \t", 3), (7, "one two", 4), (7, "one two", 4), (None, "ONE two", 5), (None, "other words here now", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    want = plain_components([(d, plain_fingerprint(t)) for d, t, _ in rows])
    assert order(map(tuple, S.near_duplicates(docs).collect())) == order(want)
    kept = S.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "other words here now"), (3, "  \t"), (7, "one two")]
    assert S.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 40])
def test_components(spread, n):
    rng = random.Random(n)
    edges = [(rng.randrange(3 * n), rng.randrange(3 * n)) for _ in range(2 * n)] + [(100 + i, 101 + i) for i in range(n)]
    want = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in want:
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    got = connected_components(spread.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted(want.items())
