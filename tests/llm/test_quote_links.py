"""Quotation linking on hand-made threads, and the query against SQL."""

from gleanframe.llm import quote_links as K
from tests.llm.oracle import assert_matches_sql


def test_documents(spread):
    assert_matches_sql(spread, "op4_quote_links", "/root/testdata/sf0.01")


def test_threads(spread):
    rows = [
        ("c", 0, "a", "Shall we meet on Monday?\nBring the  Red papers."),
        ("c", 1, "b", "Another thing: who pays for lunch?"),
        ("c", 2, "b", "> shall WE meet on monday?\n\nYes that works for me."),
        ("c", 3, "a", "> > Shall we meet on Monday?\n> Yes that works for me.\nGood, see you then."),
        ("c", 4, "d", ">> Yes that works for me.\n > Good, see you then.\n"),
        ("c", 5, "d", "> who knows where this is from\nNo idea at all."),
        ("c", 6, "e", "> Another thing: who pays for lunch?\n> Bring the red papers.\n> Shall we meet on Monday?\nBoth things."),
        ("c", 7, "e", "> Good one\nquotes of what nobody wrote link nothing"),
        ("d", 0, "x", "> Shall we meet on Monday?\nOther conversation."),
        (None, 1, "x", "First of the null ones."), (None, 2, "x", "> First of the null ones.\nok"),
        ("e", None, "x", "No turn but some text here."), ("e", 1, "x", "> No turn but some text here."), ("e", 2, None, None), ("e", 3, "x", ""),
        ("g", 0, "a", "Yes."), ("g", 1, "b", "Shall we go now or later?"), ("g", 2, "c", "> yes.\nok"), ("g", 3, "c", "> Yes.\n> Yes.\n> > Shall we go now or later?\n>  \nfine"),
        ("f", 1, "x", "Said two times by me."), ("f", 1, "x", "Said two times by me."), ("f", 2, "y", "> Said two times by me."), ("f", 2, "y", "> Said two times by me."),
    ]
    mail = spread.createDataFrame([(*r, 0) for r in rows], "conv_id string, turn long, role string, text string, position int")
    out = K.build(mail).collect()
    assert len(out) == len(rows)
    got = {(r.conv_id, r.turn): (r.parent_turn, r.thread_turn, r.depth, r.n_quoted, r.n_linked, r.body) for r in out}
    assert got["c", 0][:3] == (None, 0, 0) and got["c", 1][:3] == (None, 1, 0)
    assert got["c", 2] == (0, 0, 1, 1, 1, "Yes that works for me.")
    assert got["c", 3] == (2, 0, 2, 2, 2, "Good, see you then.")
    assert got["c", 4] == (3, 0, 3, 2, 2, "")
    assert got["c", 5] == (None, 5, 0, 1, 0, "No idea at all.")
    assert got["c", 6] == (0, 0, 1, 3, 3, "Both things.")
    assert got["c", 7][:5] == (None, 7, 0, 1, 0) and got["d", 0][:5] == (None, 0, 0, 1, 0)
    assert got[None, 2] == (1, 1, 1, 1, 1, "ok")
    assert got["e", 1][0] is None and got["e", 2][5] is None and got["e", 3][5] == ""
    assert got["f", 2][:5] == (1, 1, 1, 1, 1)
    # a single word links, but a longer line at a higher level decides against two of them
    assert got["g", 2][:5] == (0, 0, 1, 1, 1) and got["g", 3][:5] == (1, 1, 1, 4, 3)
    assert [r.turn for r in sorted((r for r in out if r.conv_id == "c"), key=lambda r: r.position)] == [0, 2, 3, 4, 6, 1, 5, 7]
    assert sorted(r.position for r in out if r.conv_id == "f") == [1, 2, 3, 4]
    assert K.build(mail.limit(0)).count() == 0


def test_long_thread(spread):
    """A thread of many answers, each to the one before it."""
    n = 70
    mail = spread.createDataFrame(
        [("c", i, "r", (f"> this is note number {i - 1}\n" if i else "") + f"this is note number {i}") for i in range(n)],
        "conv_id string, turn long, role string, text string",
    )
    got = sorted((r.turn, r.thread_turn, r.depth, r.position) for r in K.build(mail).collect())
    assert got == [(i, 0, i, i + 1) for i in range(n)]
