"""Decontamination against SQL and a plain search."""

import re

import pytest

from gleanframe.llm import decontaminate as D
from tests.llm.oracle import assert_matches_sql


def brute(texts, items, size):
    cut = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for t in texts:
        words, hit, found = cut(t), set(), set()
        for item, x in items:
            w = cut(x)
            n = min(size, len(w))
            for i in range(len(w) - n + 1) if n else ():
                for j in range(len(words) - n + 1):
                    if words[j : j + n] == w[i : i + n]:
                        hit |= set(range(j, j + n))
                        found.add(item)
        out.append((len(words), len(hit), sorted(str(f) for f in found - {None})))
    return sorted(out)


ITEMS = [(1, "a b c d e"), (2, "B, c!! d x y"), (None, "q r s t"), (3, "Zz"), (4, None), (5, "..."), (6, "a b c d e"), (7, "é ü 日本 ok")]
TEXTS = [
    "A b C d e f", "b c d x", "a-b-c-d", "q r s t u", "none", "zz", None, "", "...", "c d x y b c d x y", "É ü 日本 ok", "é ü 日本 ok a b c d",
    "a b c d " * 400, "zz " * 300,
]


@pytest.mark.parametrize("block", [1000, 3])
def test_small_cases(spark, block):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, TEXTS[0]])], "doc_id long, text string, HITS string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.find(docs, bench, size=4, block_windows=block).collect()
    assert sorted((r.hits.n_words, r.hits.n_hit, list(r.hits["items"])) for r in got) == brute([*TEXTS, TEXTS[0]], ITEMS, 4)


def test_cut_and_drop(spark):
    rows = [(1, "Keep this. A b, C d! And that."), (2, "clean"), (3, None), (4, "a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert sorted(map(tuple, D.cut_spans(docs, bench, size=4).collect())) == [(1, "Keep this. And that."), (2, "clean"), (3, None), (4, "")]
    assert sorted(r.doc_id for r in D.drop_documents(docs, bench, size=4).collect()) == [2, 3]
    assert D.report(docs.limit(0), bench).count() == 0
    assert D.find(docs, bench.limit(0)).filter("hits.n_hit > 0").count() == 0


def test_documents(spark):
    assert_matches_sql(spark, "op6_decontaminate", "/root/testdata/sf0.01")
