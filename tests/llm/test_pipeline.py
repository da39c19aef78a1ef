"""The pipeline, stage by stage against plain versions, on whole small tables."""

import hashlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from gleanframe.llm import bpe, resample
from tests.llm.test_decontaminate import brute
from tests.llm.test_pii import plain_base, plain_report
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages(spread):
    docs = spread.read.parquet(f"{SF}/documents.parquet")
    columns, got = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = spread.createDataFrame((out := stage(spread, docs, SF)).collect(), out.schema)
        after = got[name] = {r.doc_id: r for r in docs.collect()}
        if name != "bpe_tokens":
            assert docs.columns == columns
        if name == "quality_classifier":
            drawn = resample.resample(spread.read.parquet(f"{SF}/documents.parquet"), spread.read.parquet(f"{SF}/labels.parquet"))
            assert set(after) == {r.doc_id for r in drawn.filter("kept").collect()}
            assert after == {i: before[i] for i in after} and 0 < len(after) < len(before)
        elif name == "simhash_near_dedup":
            # the operator's own contract: three-word shingles, two bits
            groups = plain_components([(i, plain_fingerprint(r.text)) for i, r in before.items()])
            assert after == {i: before[i] for i, _, c in groups if i == c}
        elif name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spread.read.parquet(f"{SF}/benchmark.parquet").collect()]
            clean = {i for i, r in before.items() if brute([r.text], items, 10)[0][1] == 0}
            assert after == {i: before[i] for i in clean}
        elif name == "pii":
            assert set(after) == set(before)
            spans = {r[0]: r[6] for r in plain_report([(i, r.text) for i, r in before.items()])}
            for i, r in after.items():
                assert not plain_base(r.text) and r.n_chars == len(r.text)
                assert (r.text == before[i].text) == (spans[i] == "")
        else:
            library = Tokenizer.from_file(bpe.default_vocabulary())
            for i, r in before.items():
                ids = library.encode(r.text, add_special_tokens=False).ids
                assert after[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    ran = {r.doc_id: r for r in corpus_pipeline.run(spread, SF).collect()}
    assert ran == got["bpe_tokens"]


def test_stages_on_hard_rows(spread):
    """Nulls, empty and long texts, repeated rows, an empty table, and columns with names the operators use."""
    long = "Plain words about " + " ".join(f"thing{i}" for i in range(20_000))
    rows = [
        (1, None), (2, ""), (3, "   "), (4, long), (4, long), (5, "Write to ann@example.org today, please do so."), (None, "A text without an id, long enough to stay."),
        (6, "Some words that stand here once."), (7, "Some words that stand here once."), (8, "x"),
    ]
    names = ["__fp", "__toxic", "__base", "__terms", "__log_ratio", "__digest", "hits", "fp"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    full = [(i, x, "en", "s", len(x or ""), *names) for i, x in rows]
    docs = spread.createDataFrame(full, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spread, docs, SF)
        got = out.collect()
        assert stage(spread, docs.limit(0), SF).count() == 0
        if name == "bpe_tokens":
            assert len(got) == docs.count()
            continue
        assert out.columns == docs.columns
        assert all(tuple(r)[5:] == tuple(names) for r in got)
        if name == "simhash_near_dedup":
            # texts without words are alike, so are 6 and 7, and the repeated row
            before = {r.doc_id for r in docs.collect()}
            keep = before - {7} - {i for i in (1, 2, 3) if i in before and i != min(before & {1, 2, 3}, default=None)}
            assert sorted((r.doc_id for r in got), key=str) == sorted(keep, key=str)
        if name == "pii":
            assert all("ann@example.org" not in (r.text or "") for r in got)
        docs = spread.createDataFrame(got, out.schema)
