"""What a task holds and redoes does not grow with the table."""

import datetime

import pytest

from gleanframe import session
from gleanframe.operators import ordering as O, survey as S
from gleanframe.plans.model_queries import model_rows

G6 = {"name": "G6Q00001____Name", "said": "G6Q00002____Sustainable"}


def plan_of(df, capsys) -> str:
    capsys.readouterr()
    df.explain(True)
    return capsys.readouterr().out


def test_lookup_has_no_frame_that_is_summed_anew_for_every_row(spread, capsys):
    df = spread.createDataFrame([("a", v) for v in (5, 1, 3, 3)] + [(None, 7)], "g string, x int")
    cum = O.prefix_sums(O.value_counts(df, ["g"], "x"), ["g"], ["x"], ["n"])
    asks = spread.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0), ("a", 4, 3.0), ("a", 5, 4.0), (None, 6, 1.0)], "g string, i int, at double")
    found = O.values_at_positions(cum, ["g"], "x", asks, "at")
    assert "unboundedfollowing" not in plan_of(found, capsys)
    assert sorted((r.i, r.x) for r in found.collect()) == [(1, 1), (2, 3), (3, 3), (4, 3), (5, 5), (6, 7)]


def test_respondents_with_one_row_are_joined_with_nothing(spark, capsys):
    rows = [(i, f"Taxon {i}", "No" if i % 2 else "Yes") for i in range(20)] + [(None, "Taxon", "No"), (None, "Taxon", "Yes")]
    df = spark.createDataFrame(rows, f"id int, `{G6['name']}` string, `{G6['said']}` string")
    out = S.mention_pipeline(df, [6])
    assert "Join" not in plan_of(out, capsys)
    got = {(r.id, r.sustainability, r.known_unsustainable) for r in out.collect()}
    want = {(i, "Unsustainable", "Yes") if i % 2 else (i, "Sustainable", None) for i in range(20)}
    assert got == want | {(None, "Unsustainable", "Yes"), (None, "Sustainable", None)}


@pytest.mark.parametrize("task_rows", [1, 500_000])
def test_a_mention_called_unsustainable_reaches_the_other_rows(spark, monkeypatch, capsys, task_rows):
    monkeypatch.setattr(session, "TASK_ROWS", task_rows)
    cores = spark.sparkContext.defaultParallelism
    rows = [(i // 2, f"Taxon {i}", "No" if i % 8 == 1 else "Yes") for i in range(2 * cores + 2)]
    df = spark.createDataFrame(rows, f"id int, `{G6['name']}` string, `{G6['said']}` string")
    out = S.mention_pipeline(df, [6])
    assert ("REPARTITION_BY_NUM" in plan_of(out, capsys)) == (task_rows == 1)
    got = {(r.id, r.name, r.known_unsustainable) for r in out.collect()}
    assert got == {(i, n, "Yes" if i % 4 == 0 else None) for i, n, _ in rows}


@pytest.fixture
def tables(spark, tmp_path):
    day, n = datetime.datetime(2020, 1, 1), 3 * spark.sparkContext.defaultParallelism
    made = {
        "nation": ([(0, "PERU", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "AMERICA")], "r_regionkey int, r_name string"),
        "part": ([(i, f"Brand#{i}", "LARGE") for i in range(3)], "p_partkey long, p_brand string, p_type string"),
        "customer": ([(i, 0, "BUILDING", 100.0 * i) for i in range(4)], "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double"),
        "orders": ([(i, i % 5 if i else None, "F", day, "1-URGENT") for i in range(9)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": ([(i % 10 if i else None, i % 3, i % 2 * 1.0, "R" if i % 4 else "N") for i in range(n)], "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_model_rows_are_dealt_by_their_number(spark, tables, monkeypatch, capsys):
    few = model_rows(spark, tables)
    assert "REPARTITION_BY_NUM" not in plan_of(few, capsys)
    want = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(session, "TASK_ROWS", 1)
    many = model_rows(spark, tables)
    assert "REPARTITION_BY_NUM" in plan_of(many, capsys)
    assert want and sorted(map(tuple, many.collect())) == want == sorted(set(want))
