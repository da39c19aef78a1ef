"""Secret scans: candidates against a plain search, features by hand, held-out labels."""

import random
import re
import string
from collections import Counter

import regex
from pyspark.sql import functions as F

from gleanframe.llm import secret_scan as S
from gleanframe.llm.queries import QUERIES


WORD = r"(?:secret|token|passw|pwd|api.?key|access.?key|private.?key|credential|auth|bearer)"
LINK = rf"(?i:{WORD})[\w\-]{{0,16}}[\"'`]?(?:[ \t]{{0,3}}[:=][ \t]{{0,3}}|[ \t]{{1,3}}(?:is[ \t]{{1,3}})?(?=[\"'`]))"


def plain_named(text):
    """Spans of values after a credential word: every place where the words before it end, leftmost first."""
    starts = sorted({m.end() for link in (LINK, LINK + "[\"'`]") for m in regex.finditer(link, text, overlapped=True)})
    out, done = [], 0
    for at in starts:
        if at < done or at >= len(text):
            continue
        if text[at - 1] in "\"'`":
            m = re.compile(rf"(?=[ \t]*[^\s{text[at - 1]}])[^{text[at - 1]}\n]+(?={text[at - 1]})").match(text, at)
        else:
            m = None
        if m is None and text[at - 1] in ":= \t":
            m = re.compile(r"[^\s\"'`](?:\S*[^\s.,;:!?)\]}>\"'`])?").match(text, at)
        if m:
            out.append(m.span())
            done = m.end()
    return out


def plain_candidates(text):
    text, at, gaps, named = text or "", 0, [], []
    for a, b in plain_named(text):
        named.append(text[a:b])
        gaps.append(text[at:a])
        at = b
    out = [(v, None, None) for v in named]
    for gap in [*gaps, text[at:]]:
        for m in re.finditer(r"[A-Za-z0-9_\-+/=.~]+", gap):
            if len(m[0]) >= 16 and re.search("[0-9]", m[0]):
                out.append((m[0], gap[: m.start()], gap[m.end() :]))
    return out


def test_values_after_credential_words(spark):
    rows = [
        ('password: "Summer2024"', ["Summer2024"]), ("pwd='hunter2', and more", ["hunter2"]), ("password=p@$$w0rd!#^&*x next", ["p@$$w0rd!#^&*x"]),
        ("API_KEY = `letters only here`", ["letters only here"]), ("the secret is 'a\"b'", ['a"b']), ("my_secret_key=abcdefghij1234567890", ["abcdefghij1234567890"]),
        ("password:", []), ("password: \n next", []), ('password ""', []), ('token: " "', []), ("the token of the house", []), ("auth_token: (x).", ["(x"]),
        ('{"client_secret": "q"}', ["q"]), ("passwort", []), ("", []), (None, []), ("password: 'never closed", []), ("Password: ü", ["ü"]),
        ("token: " + "a" * 50_000 + "!" * 50_000, ["a" * 50_000]),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {}
    for r in S.candidates(docs).collect():
        got.setdefault(r.id, []).append(r.value)
    for i, (t, want) in enumerate(rows):
        assert got.get(i, []) == want == [v for v, _, _ in plain_candidates(t)], (t, want, got.get(i))


def test_short_and_letter_only_secrets_are_found(spark):
    """The forest judges short values by what it learnt, whatever their alphabet; prose after the word is left alone."""
    rng, rows = random.Random(8), []
    for i in range(300):
        value = "".join(rng.choices(string.ascii_letters + "!@#$%^&*", k=rng.randint(7, 12)))
        rows.append((i, [f'here password: "{value}" end', "the token: house and garden", "see /usr/share/doc/file1.txt house garden"][i % 3]))
    out = {(r.doc_id, r.value): r.secret for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string"), rule=S.weak_label()).collect()}
    assert all(v == (i % 3 == 0) for (i, _), v in out.items()) and len(out) == 300


def test_documents(spread):
    sf = "/root/testdata/sf0.01"
    docs = spread.read.parquet(f"{sf}/documents.parquet")
    want = sorted((d.doc_id, i, v) for d in docs.collect() for i, (v, _, _) in enumerate(plain_candidates(d.text)))
    found = S.candidates(docs).collect()
    assert sorted((r.id, r.place, r.value) for r in found) == want and want
    texts = {d.doc_id: d.text for d in docs.collect()}
    held = Counter(w for t in texts.values() for w in set(re.findall("[a-z]{3,}", t.lower())))
    words = {w for w, n in held.items() if n >= S.DICTIONARY_DOCS}
    out = QUERIES["op7_secret_forest"](spread, sf).collect()
    assert len(out) == len(want)
    by = {(d, p): v for d, p, v in want}
    for r in out:
        v = by[r.doc_id, r.place]
        letters = sum(len(w) for w in re.findall("[a-z]{3,}", v.lower()) if w in words)
        assert abs(r.coverage - letters / len(v)) < 1e-6
        assert r.secret == (re.fullmatch("[0-9a-f]{40}", v) is not None), v


def test_neighbours_and_features(spark):
    rows = [(1, 'x API_KEY = "aB3dE6gH9jK2mN5p" next'), (2, None), (3, ""), (4, "see /usr/share/doc/file1.txt 4111111111111111"), (None, "a1" * 50_000 + " " + "b" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = S.features(S.candidates(docs), spark.createDataFrame([("/usr/share/doc/file1.txt", 0.5)], "value string, coverage double")).collect()
    at = {(r.id, r.place): r for r in found}
    assert sorted(at, key=str) == [(1, 0), (4, 0), (4, 1), (None, 0)]
    key, path, card = at[1, 0], at[4, 0], at[4, 1]
    assert (key.before, key.after) == ('x API_KEY = "', '" next')
    assert (key.credential_before, key.assigned, key.quoted, key.number, key.digits, key.runs, key.distinct) == (1, 1, 1, 0, 5 / 16, 1.0, 1.0)
    assert (path.slashes, path.dots, path.coverage) == (4, 1, 0.5)
    assert (card.before, card.number, card.hex, card.quoted) == (" ", 1, 1, 0)


def test_forest_on_held_out_findings(spark):
    rng = random.Random(4)
    rows, truth = [], {}
    for i in range(400):
        secret = i % 2
        value = "".join(rng.choices(string.ascii_letters + string.digits, k=32)) + "7" if secret else "/".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=5)) + "/v1"
        rows.append((i, f"alpha beta gamma delta {rng.choice(['in', 'of', 'token:'])} {value} end"))
        truth[i] = secret
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = spark.createDataFrame([(i, 0, truth[i]) for i in range(200)], "doc_id long, place int, label int")
    out = S.scan(docs, labelled).collect()
    right = [int(r.secret) == truth[r.doc_id] for r in out if r.doc_id >= 200]
    assert len(right) == 200 and sum(right) / 200 > 0.97


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "abcdefgh12345678"), (1, "abcdefgh12345678"), (2, None)], "doc_id long, text string")
    assert [(r.secret, r.chance) for r in S.scan(docs).collect()] == [(None, None), (None, None)]
    assert S.scan(docs.limit(0), rule=S.weak_label()).count() == 0
