"""Quality rules against SQL, plain counts and exact binomial tails."""

import math
import re
from collections import Counter

from gleanframe.llm import quality_rules as Q
from tests.llm.oracle import assert_matches_sql


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {p for i, w in enumerate(windows) if n[w] > 1 for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered))


TEXTS = [
    None, "", " \t\x0b\n", "a b c d", "a b c d e", "a b c d e a b c d e", "a a a a a a", "a a a a a a a", "x\nx\n\n\n x\nx", "#*$ <é&>|%",
    " lead a b c d e f g a b c d e f g ", "w " * 3000, "one two three four five " * 50 + "\n" + "one two three four five", "日本 語 😀 é ü ñ\r\nA\x1cB",
]


def test_counts(spread):
    docs = spread.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, other int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in Q.signals(docs).collect()}
    assert got == {i: plain_counts(t) for i, t in enumerate(TEXTS)}


def test_tail_is_the_exact_binomial(spark):
    limit = 0.01
    rows = [(n, k) for n in (1, 50, 800, 20000) for k in {0, 1, min(n, 7), int(n * limit), n}]
    got = spark.createDataFrame(rows, "n long, k long").selectExpr("n", "k", Q.TAIL.format(limit="0.01D") + " AS t").collect()
    for r in got:
        want = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(limit) + (r.n - i) * math.log(1 - limit)) for i in range(r.k + 1))
        assert r.t == 1.0 if r.k >= r.n * limit + 1 else abs(r.t - want) < 1e-9


def test_documents(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert_matches_sql(spark, "op1_risk_controlled_rules", sf)


def test_cutoffs_keep_good_documents(spread):
    """Junk with symbols goes, the stratum with few labels keeps all, clean documents stay."""
    word = "word " * 5
    clean = [(i, f"{word}{i} a{i} b c{i} d e{i} f g{i}", "en", None) for i in range(900)]
    junk = [(1000 + i, f"a{i}### b{i}### c{i}### d### e### f### g### h### i### j###", "en", None) for i in range(100)]
    other = [(2000 + i, f"a{i}### b{i}### c{i}### d### e### f### g### h### i### j###", None, None) for i in range(10)]
    docs = spread.createDataFrame([*clean, *junk, *other, (None, None, None, None), (5, None, "en", None)], "doc_id long, text string, lang string, stratum int")
    labels = spread.createDataFrame([(i, 1) for i in range(900)] + [(1000 + i, 0) for i in range(100)] + [(2000, 1), (None, 1), (77777, 1)], "doc_id long, quality int")
    out = Q.judge(docs, labels).collect()
    assert {r.doc_id for r in out if r.kept} == {i for i, *_ in clean} | {2000 + i for i in range(10)}
    assert {r.failed_rules for r in out if (r.doc_id or 0) in range(1000, 1100)} == {"symbols"}
    assert len(out) == 1012 and sum(r.base_failed for r in out) == 2
    tests = Q.thresholds(Q.signals(docs), labels).filter("used").collect()
    assert all(r.tail <= Q.DELTA / 6 for r in tests) and {r.stratum for r in tests} == {"en"}
    assert Q.judge(docs.limit(0), labels).count() == 0
    assert Q.judge(docs, labels.limit(0)).filter("not kept").count() == 2


def test_joint_rejection_has_power_in_every_stratum(spark):
    """On the larger tables each language gets rules, and they cost under the limit of its good documents."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = docs.select("doc_id", "lang").distinct().join(labels, "doc_id")
    judged = Q.judge(docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi"), labels)
    rows = judged.distinct().join(known, "doc_id").filter("not base_failed").toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    lost = (~good.kept).groupby(good.lang).mean()
    caught = (~bad.kept).groupby(bad.lang).mean()
    print(lost, caught)
    assert set(lost.index) == {"de", "en", "es", "fr"} and (lost <= Q.ALPHA).all()
    assert (caught > 0.5).all()
