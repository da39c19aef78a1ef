"""Personal data: spans against the plain patterns, disclosure against plain counts."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest

from gleanframe.llm import pii as P
from gleanframe.llm.queries import QUERIES


def plain_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = digits(m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def plain_report(rows):
    """rows: (id, text) -> (id, four counts, digest, spans, number of terms)."""
    texts = [t or "" for _, t in rows]
    bases = [plain_base(t) for t in texts]
    holds, with_term, joint, held = Counter(), Counter(), Counter(), []
    for t, base in zip(texts, bases):
        entities = {P.entity_of(k, t[a:b]) for a, k, b in base}
        holds.update(entities)
        words = [(m.start(), m.end(), m[0].lower()) for m in P.TERM.finditer(t)]
        with_term.update({w for _, _, w in words})
        mine = [x for x in words if not any(x[0] < y and a < x[1] for a, _, y in base)]
        joint.update({(c, w) for c in entities for _, _, w in mine})
        held.append((entities, mine))
    out = []
    for (i, _), base, (entities, mine) in zip(rows, bases, held):
        terms = set()
        for c in entities:
            rate = holds[c] / len(rows)
            for s, e, w in mine:
                given = (joint[c, w] + P.SMOOTHING * rate) / (with_term[w] + P.SMOOTHING)
                if rate < 1 and round(math.log(given / rate) / -math.log(rate), 9) >= P.GENERALISE:
                    terms.add((s, 4, e))
        show = lambda spans: ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        counts = [sum(k == n for _, k, _ in base) for n in range(4)]
        out.append((i, *counts, hashlib.sha256(show(base).encode()).hexdigest(), show(base + sorted(terms)), len(terms)))
    return sorted(out, key=str)


def test_patterns():
    random.seed(11)
    parts = ["a", "b.c", "@", "x-1", ".", "1", "25", "256", "1.2.3.4", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "%", "_", "é", "+1 (499) 555-6503", "0", "\n"]
    for _ in range(20000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 12)))
        assert P.base_spans(text) == plain_base(text), text


def test_long_runs_are_read_once():
    start = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "+1" + "-" * 300_000, "1." * 150_000, "a@" * 100_000, "a@b" * 100_000):
        P.base_spans(text)
    assert time.time() - start < 20


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_documents(spread, sf):
    docs = [(d.doc_id, d.text) for d in spread.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op3_pii_disclosure"](spread, sf).collect()), key=str) == plain_report(docs)


def test_sanitise(spread):
    rows = [
        (1, "Dr Quux wrote from a.b@c.org today", "x"), (2, "ask Quux at A.B@c.org today", "x"), (2, "ask Quux at A.B@c.org today", "x"),
        (3, "nothing today", None), (4, None, None), (5, "", None), (None, "call +1 499 555 6503 today", None),
    ] + [(10 + i, "other words today", None) for i in range(30)]
    docs = spread.createDataFrame(rows, "doc_id long, text string, entity string")
    out = P.sanitise(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text) for r in out.collect() if (r.doc_id or 0) < 10)
    # "call" stands in one document, the only one with the number; "Quux" in all three with the address
    assert got[0] == (0, "[WORD] [PHONE] today")
    assert (1, "Dr [NAME] wrote from [EMAIL] today") in got and got.count((2, "[WORD] [NAME] [WORD] [EMAIL] today")) == 2
    assert (3, "nothing today") in got and (4, None) in got and (5, "") in got
    assert sorted(map(tuple, P.report(docs).collect()), key=str) == plain_report([r[:2] for r in rows])
    assert P.report(docs.limit(0)).count() == 0 and P.sanitise(docs.limit(0)).count() == 0


def test_far_terms_and_strong_ones(spread):
    """A term far from its entity, in one document; and one that so many documents tie to it that it goes."""
    filler = "today some words " * 3000
    rows = [(0, f"Xanthippe {filler} 10.1.2.3 {filler} xanthippe")]
    rows += [(i, f"zorblax {i} at b@d.org today some words") for i in range(1, 41)]
    rows += [(i, "today some words") for i in range(41, 1200)]
    out = {r.doc_id: r.text for r in P.sanitise(spread.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == f"[NAME] {filler} [IP] {filler} [WORD]"
    assert out[7] == " 7  [EMAIL] today some words" and out[50] == "today some words"


def test_entities_of_the_same_texts(spread):
    """Hundreds of entities in one text meet its words as one class; a text in many copies is worked on once."""
    rows = [(0, " ".join(f"m{i}@d.org" for i in range(300)) + " frimble grout"), (1, "m7@d.org frimble")]
    rows += [(10 + i, "c@d.org vexil plain") for i in range(50)] + [(100 + i, "plain words") for i in range(400)]
    docs = spread.createDataFrame(rows, "doc_id long, text string")
    found = P.scan(docs, "text", [])
    classes = P.entity_classes(found).collect()
    assert sorted((r.n, r.n_entity) for r in classes) == [(1, 1), (1, 2), (1, 2), (50, 50)]
    assert sorted(map(tuple, P.report(docs).collect()), key=str) == plain_report(rows)


def test_mentions_leave_spans_alone():
    text = "ééa@b.org-x word 1.2.3.4abc tail"
    spans = [(a, b) for a, _, b in P.base_spans(text)]
    assert [t for t, _, _ in P.mentions(text, spans)] == [m[0].lower() for m in P.TERM.finditer(text) if not any(m.start() < b and a < m.end() for a, b in spans)]


def test_overlapping_spans_and_kinds_of_word():
    base = [{"kind": "card", "start": 1, "end": 9}, {"kind": "phone", "start": 0, "end": 6}]
    assert P.rewritten("0123456789 Ab cd", base, [{"start": 11, "end": 13, "remove": False}, {"start": 14, "end": 16, "remove": True}]) == "[PHONE]9 [NAME] "
