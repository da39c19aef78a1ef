"""Figures that must not grow with the table, and shuffles that small tables spare."""

import pytest

from gleanframe import session
from gleanframe.operators import rules as R
from gleanframe.session import materialise, written
from gleanframe.sources import standins


def plan_of(df, capsys) -> str:
    capsys.readouterr()
    df.explain(True)
    return capsys.readouterr().out


@pytest.fixture
def tables(spark, tmp_path):
    made = {
        "part": ([(1, "Brand#1", "LARGE"), (1, "Brand#1", "LARGE"), (2, "Brand#2", "SMALL"), (None, "Brand#3", "SMALL")], "p_partkey long, p_brand string, p_type string"),
        "lineitem": ([(1, "R"), (1, "N"), (2, "R"), (3, "R"), (None, "R")], "l_partkey long, l_returnflag string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("task_rows", [3, 500_000])
def test_mentions_are_not_sorted_to_meet_a_long_table_of_names(spark, tables, monkeypatch, capsys, task_rows):
    monkeypatch.setattr(session, "TASK_ROWS", task_rows)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = standins.mentions(spark, tables, "name", "answer")
        assert ("ShuffledHashJoin" in plan_of(df, capsys)) == (task_rows == 3)
        want = [("Brand#1", "Sustainable")] * 2 + [("Brand#1", "Unsustainable")] * 2 + [("Brand#2", "Unsustainable")]
        assert sorted(map(tuple, df.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_answers_are_not_shuffled_to_meet_few_rules(spark, capsys):
    answers = spark.createDataFrame(
        [(1, "a", "X-Y", "north", "yes"), (1, "a", "X-Y", "north", "yes"), (2, "a", "Z", "south", "no"), (3, "b", "Z", "south", "IDK"), (4, None, "X Y", "north", "no"), (5, "a", "Z", "south", None)],
        "id int, name string, area string, zone string, regulation string",
    )
    rules = spark.createDataFrame(
        [("a", "Département", "X Y", "Protection départementale", "Protection", "PD"), ("b", "Département", "X Y", "Protection départementale", "Protection", "PD"),
         ("b", "État", "France", "Liste rouge", "Listes rouges", "LRN"), (None, "État", "France", "Protection nationale", "Protection", "PN")],
        "name string, level string, place string, status_label string, grouping string, status_code string",
    )
    df = R.answers_with_status(materialise(answers), written(rules, "rules"), {"department": "area", "region": "zone", "national": None})
    # the size of a checkpoint is not known, so a join with one sorts both sides
    plan = plan_of(df, capsys).split("== Physical Plan ==")[1]
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    got = sorted(((r.id, r.name, r.regulation, r.status_group, r.national_status) for r in df.collect()), key=str)
    some = "At least 1 regulation or protection"
    assert got == [
        (1, "a", "Yes", "Department-level protection", some),
        (3, "b", "IDK", "No regulation/protection", some),
        (4, None, "No", "No regulation/protection", None),
    ]


def test_line_items_that_no_rule_tests_are_left_out_before_the_joins(spark, tmp_path, capsys):
    made = {
        "lineitem": ([(1, 1, 50.0, 0.08), (1, 1, 48.0, 0.08), (2, 1, 1.0, 0.0), (2, 1, 5.0, 0.0), (1, 1, 4.0, 0.0), (1, 1, None, 0.0), (1, 1, 4.0, None)], "l_partkey long, l_suppkey long, l_quantity double, l_tax double"),
        "part": ([(1, "Brand#11"), (2, "Brand#21")], "p_partkey long, p_brand string"),
        "supplier": ([(1, 0)], "s_suppkey long, s_nationkey int"),
        "nation": ([(0, "PERU", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "AMERICA")], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    df = standins.rules(spark, str(tmp_path))
    physical = plan_of(df, capsys).split("== Physical Plan ==")[1]
    assert "IN (1.0,2.0,3.0,4.0)" in physical.replace(" ,", ",") and "PushedFilters: [Or(" in physical
    assert sorted((r.name, r.status_code) for r in df.collect()) == [("Brand#11", "LRN"), ("Brand#11", "PD"), ("Brand#21", "PR")]
