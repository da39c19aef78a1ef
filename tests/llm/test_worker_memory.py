"""Python workers of one executor hold one step's data and do no needless work."""

import numpy as np

from gleanframe.llm import bpe, pii
from gleanframe.llm.bpe import UnitEncoder, packed


def test_texts_without_personal_data_go_through_one_python_step(spark, capsys):
    docs = spark.createDataFrame([(1, "write to ann@example.org now"), (2, "nothing here"), (3, None), (4, ""), (2, "nothing here")], "doc_id long, text string")
    df = pii.sanitise(docs)
    capsys.readouterr()
    df.explain(True)
    physical = capsys.readouterr().out.split("== Physical Plan ==")[1]
    assert physical.index("Union") < physical.index("MapInArrow")
    got = sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert [g for g in got if g[0] != 1] == [(2, "nothing here"), (2, "nothing here"), (3, None), (4, "")]
    assert "[EMAIL]" in dict(got)[1] and "ann@" not in dict(got)[1]


def test_an_added_token_of_letters_is_cut_out_of_words():
    made = []
    encoder = UnitEncoder(lambda w: made.append(w) or packed([len(w)]), {"xyz": 7, "<s>": 8})
    assert np.frombuffer(encoder.encode("an axyzb <s>, plain"), "<u4").tolist() == [2, 2, 7, 1, 1, 8, 1, 6]
    assert made == ["an", " a", "b", " ", ",", " plain"]


def test_a_word_of_letters_is_not_matched_against_patterns(monkeypatch):
    monkeypatch.setattr(bpe, "USUAL", None)
    assert UnitEncoder(lambda w: packed(list(range(40))), {"<s>": 8}).encode("an élan") == packed(list(range(40))) * 2
