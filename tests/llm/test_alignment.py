import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from gleanframe.llm import alignment, bpe
from gleanframe.llm.queries import QUERIES

LETTERS = bpe.byte_letters()
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def ranges(ids, sizes):
    out, at = [], 0
    for i, n in zip(ids, sizes):
        out.append((i, at, at + n))
        at += n
    return out


def plain_tokens(text):
    if not text:
        return [], []
    a = A.encode(" " + text, add_special_tokens=False)
    b = B.encode(text)
    a_bytes = [bytes(LETTERS[c] for c in A.id_to_token(i)) for i in a.ids]
    b_bytes = [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, B.id_to_piece(i)) for i in b)]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return [], []
    return ranges(a.ids, map(len, a_bytes)), ranges(b, map(len, b_bytes))


def plain_links(a, b):
    """Every pair whose ranges overlap, by a walk over both."""
    out, j = [], 0
    for i, (_, s, e) in enumerate(a):
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            out.append((i, k))
            k += 1
    return out


def plain_report(docs):
    parts = [(i, *plain_tokens(x)) for i, x in docs]
    links = [[(a[p][0], b[q][0]) for p, q in plain_links(a, b)] for _, a, b in parts]
    held = Counter(pair for own in links for pair in set(own))
    highest = {}
    for (a, _), n in held.items():
        highest[a] = max(n, highest.get(a, 0))
    out = []
    for (i, a, b), own in zip(parts, links):
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        start, groups = 0, []
        for c in cuts:
            groups.append("|".join(",".join(str(t) for t, s, e in side if start <= s and e <= c) for side in (a, b)))
            start = c
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((i, len(a), len(b), len(cuts), len(own), sum(held[p] == highest[p[0]] for p in own), sum(held[p] for p in own), digest))
    return sorted(out, key=str)


def got(df):
    names = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    assert sorted(df.columns) == sorted(names)
    assert dict(df.dtypes) == {n: "string" if n == "groups_sha256" else "bigint" for n in names}
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def short(rows, most=4000):
    """Groups are told apart slowly above."""
    return [(i, x if x is None else x[:most]) for i, x in rows]


def test_documents(spread):
    docs = spread.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = short([tuple(r) for r in docs.collect()], 1500)
    assert got(alignment.report(spread.createDataFrame(rows, docs.schema).repartition(5))) == plain_report(rows)
    whole = {r[0]: r for r in got(QUERIES["op12_token_alignment"](spread, "/root/testdata/sf0.001"))}
    for i, x in [tuple(r) for r in docs.collect()]:
        a, b = plain_tokens(x)
        assert whole[i][1:3] == (len(a), len(b)) and whole[i][4] == len(plain_links(a, b) if a else [])


EDGES = [
    (1, None), (2, ""), (3, "x"), (3, "x"), (4, " "), (5, "   a  b\n\n c "), (None, "a null id"), (6, "▁ lost"), (7, "<|endoftext|> <s> <unk> <0x41>"),
    (8, "nul\0 in it"), (9, "\U0001f600 ñ é é 日本語 ​"), (10, "\x85\x1c　"), (11, "word " * 3000), (12, " " * 5000 + "\n" * 3000),
    (13, "a" * 3000), (14, "The same words here."), (15, "The same words here."), (16, "The same words there."),
]


def test_edges(spread, monkeypatch):
    df = spread.createDataFrame([(i, x, 1, "e", 0) for i, x in EDGES], "doc_id long, text string, n_a int, book string, batch int").repartition(3)
    assert got(alignment.report(df)) == plain_report(EDGES)
    monkeypatch.setattr(alignment, "DOCS", 2)
    assert got(alignment.report(df)) == plain_report(EDGES)
    assert got(alignment.report(df.limit(0))) == []
    assert got(alignment.report(df.filter("text IS NULL"))) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_align(spread):
    df = spread.createDataFrame([(i, x, "old") for i, x in EDGES], "doc_id long, text string, links string").repartition(2)
    out = alignment.align(df)
    assert out.columns == ["doc_id", "text", "a_ids", "a_ends", "b_ids", "b_ends", "cuts", "links"]
    rows = out.collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        a, b = plain_tokens(r.text)
        assert list(zip(r.a_ids, r.a_ends)) == [(i, e) for i, _, e in a] and list(zip(r.b_ids, r.b_ends)) == [(i, e) for i, _, e in b]
        assert [tuple(x) for x in r.links] == plain_links(a, b)
        assert r.cuts == sorted({e for _, _, e in a} & {e for _, _, e in b})
    assert alignment.align(df.limit(0)).count() == 0


def test_one_long_text(spark):
    text = "Some words, über-long and so on.\n" * 60_000
    (row,) = got(alignment.report(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    a, b = plain_tokens(text)
    assert row[1:3] == (len(a), len(b)) and row[4] == len(plain_links(a, b)) and row[5] <= row[4] == row[6]
