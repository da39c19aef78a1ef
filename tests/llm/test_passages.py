"""Repeated lines against SQL and a plain version."""

import random
import re

from gleanframe.llm import passages as L
from tests.llm.oracle import assert_matches_sql


def test_documents(spread):
    assert_matches_sql(spread, "op5_repeated_lines", "/root/testdata/sf0.01")


def test_small_cases(spread):
    rows = [
        (2, "one two three four five\nshort\nsix seven eight nine ten", "x"),
        (1, "ONE  two three\tfour five\nshort", "x"),
        (3, "a b c d e\na b c d e\nown words only in here", "x"), (None, "a b c d e", "x"), (4, None, "x"), (5, "", "x"),
        (6, "same same same same same", "x"), (6, "same same same same same", "x"),
        (7, "head\nsix seven eight nine ten", "x"),
    ]
    docs = spread.createDataFrame(rows, "doc_id long, text string, kept_spans string")
    got = sorted((tuple(r)[:4] for r in L.report(docs, least_words=5).collect()), key=str)
    assert got == sorted(
        [(1, 1, 0, ""), (2, 2, 1, "0:23"), (3, 3, 1, "10:19"), (None, 1, 1, "0:9"), (4, 0, 0, ""), (5, 0, 0, ""), (6, 1, 0, ""), (6, 1, 0, ""), (7, 1, 1, "5:29")],
        key=str,
    )
    # short lines are units too
    got = {(r.doc_id, r.n_units, r.n_removed, r.removed) for r in L.report(docs).collect()}
    assert {(1, 2, 0, ""), (2, 3, 2, "0:23,24:29"), (7, 2, 1, "5:29"), (4, 0, 0, "")} <= got
    out = {(r.doc_id, r.text): [tuple(s) for s in r.kept_spans] for r in L.remove(docs, least_words=5).collect()}
    assert out[(2, "short\nsix seven eight nine ten")] == [(24, 54)]
    assert out[(3, "a b c d e\nown words only in here")] == [(0, 10), (20, 42)]
    assert out[(None, "")] == [] and out[(4, None)] == [] and out[(7, "head\n")] == [(0, 5)]
    assert L.report(docs.limit(0)).count() == 0 and L.remove(docs.limit(0)).count() == 0


def test_paragraphs(spark):
    docs = spark.createDataFrame([(1, "a b\nc d e\n\nx"), (2, "y\n \n\nA B\nC d e")], "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in L.report(docs, unit="paragraph", least_words=5).collect()) == [(1, 1, 0, ""), (2, 1, 1, "5:14")]


def plain_passages(rows, long_words):
    """(doc_id, text) to (long passages, words of the longest), by looking at every line."""
    seen, told = {}, {}
    for i, x in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, str(r[1]))):
        at, units = 0, []
        for line in (x or "").split("\n"):
            if plain := L.normalised(line):
                units.append((at, at + len(line), plain))
                seen.setdefault(plain, set()).add((i is None, i or 0, at))
            at += len(line) + 1
        told[i, x] = units
    out = {}
    for (i, x), units in told.items():
        runs, now = [], []
        for a, b, plain in [*units, (0, 0, b"")]:
            if plain and len(seen[plain]) > 1:
                now.append((a, b, len(plain.split(b" ")), min(seen[plain]) == (i is None, i or 0, a)))
            elif now:
                runs.append((now[0][0], now[-1][1], sum(w for _, _, w, _ in now), len(now), sum(k for *_, k in now)))
                now = []
        told_runs = ",".join(f"{a}:{b}:{n}:{k}" for a, b, w, n, k in runs if w > long_words)
        out[i, x] = (sum(w > long_words for _, _, w, _, _ in runs), told_runs, max((w for _, _, w, _, _ in runs), default=0))
    return out


def test_passages_of_neighbouring_lines(spread):
    shared = ["alpha beta gamma", "", "delta epsilon", "zeta eta theta iota"]
    rows = [
        (1, "\n".join(["own start", *shared, "own end"])), (2, "\n".join([*shared, "another end", "alpha beta gamma"])), (3, "delta epsilon\nnew\nZETA eta  theta iota"),
        (4, None), (5, ""), (6, "\n\n \n"), (7, "same\nsame"), (8, "twice told row"), (8, "twice told row"), (None, "\n".join(shared)), (9, "word " * 40_000 + "\nx"),
    ]
    docs = spread.createDataFrame([(i, x, 1, "s") for i, x in rows], "doc_id long, text string, no int, spans string").repartition(3)
    for most in (5, 50):
        want = plain_passages(rows, most)
        texts = {r.doc_id: r for r in L.report(docs, long_words=most).collect()}
        for i, x in rows:
            assert (texts[i].n_long_passages, texts[i].long_passages, texts[i].longest_passage) == want[i, x], (i, most)
    assert L.report(docs).count() == len(rows)


def plain_shared(rows, long_words):
    """Sorted rows of ``shared``, by looking up every window."""
    size, holders, seen = long_words + 1, {}, []
    for i, x in rows:
        words = [(m.start(), m.end(), L.normalised(m[0])) for m in re.finditer(r"[^ \t\n\v\f\r]+", x or "")]
        keys = [tuple(w for *_, w in words[k : k + size]) for k in range(len(words) - size + 1)]
        seen.append((i, words, keys))
        for key in keys:
            holders.setdefault(key, set()).add((i, x))
    out = []
    for i, words, keys in seen:
        covered = [False] * len(words)
        for k, key in enumerate(keys):
            if len(holders[key]) > 1:
                covered[k : k + size] = [True] * size
        told = [(a.start(), a.end()) for a in re.finditer("1+", "".join("01"[c] for c in covered))]
        spans = ",".join(f"{words[a][0]}:{words[b - 1][1]}:{b - a}" for a, b in told)
        out.append((i, len(words), len(told), spans, max((b - a for a, b in told), default=0)))
    return sorted(out, key=str)


def test_passages_within_lines(spread):
    pick = random.Random(5)
    text = lambda n: [pick.choice("abcdefgh") + str(pick.randrange(4000)) + pick.choice(["", ".", "\u00e9", "\U0001f600"]) for _ in range(n)]
    menu, rows, planted, clean = "home about contact", [], set(), set()
    for k in range(30):
        passage = text(51 + k)
        for i in (2 * k, 2 * k + 1):
            # in one line with words of its own, in other cases and spaces
            shown = [w[0].upper() + w[1:] if i % 2 else w for w in passage]
            rows.append((i, " ".join([*text(9), *shown[:30]]) + ("  " if i % 2 else "\n") + " ".join([*shown[30:], *text(7)])))
            planted.add(i)
    for i in range(100, 130):
        rows.append((i, "\n".join([menu, " ".join(text(80)), menu])))
        clean.add(i)
    some = text(50)
    rows += [(i, " ".join([*some, *text(20)])) for i in (200, 201)]
    clean |= {200, 201}
    docs = spread.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in L.shared(docs).collect()), key=str)
    assert got == plain_shared(rows, 50)
    assert {i for i, _, n, *_ in got if n} == planted and {i for i, _, n, *_ in got if not n} == clean
    # whole lines alone tell neither
    lines = {r.doc_id: r for r in L.report(docs).collect()}
    assert not any(lines[i].n_long_passages for i in planted) and all(lines[i].longest_passage for i in range(100, 130))


def test_shared_small_cases(spread):
    rows = [
        (1, "a b c d e f"), (2, "x A  b\tC\nd y"), (3, "a b c q b c d e"), (4, None), (5, ""), (6, " \n "), (7, "a b"), (7, "a b"), (8, "z z z z z z"),
        (9, "same words here twice"), (9, "same words here twice"), (10, " copy of a text "), (11, " copy of a text "), (11, " copy of a text "),
        (12, "one id two texts u"), (12, "v one id two texts"), (None, "no id at all"), (None, "no id at all"), (13, "lone lone lone lone"),
        (14, "p1 p2 p3 p4 p5 p6"), (15, "p1 p2 p3"), (16, "p4 p5 p6"), (17, "copy of a text and more"),
    ]
    docs = spread.createDataFrame([(i, x, 1, "s") for i, x in rows], "doc_id long, text string, n_words int, wanted string").repartition(3)
    for most in (0, 1, 2, 3, 5, 50):
        assert sorted((tuple(r) for r in L.shared(docs, long_words=most).collect()), key=str) == plain_shared(rows, most), most
    assert L.shared(docs.limit(0)).count() == 0


def test_shared_documents(spread):
    docs = spread.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = plain_shared([tuple(r) for r in docs.collect()], 50)
    assert any(n for _, _, n, *_ in want)
    assert sorted((tuple(r) for r in L.shared(docs).collect()), key=str) == want
