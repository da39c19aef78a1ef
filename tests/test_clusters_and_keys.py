"""Condensed clustering at any size, cluster names, accent-blind keys, classes from a fit."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleanframe.functions.text import accent_blind
from gleanframe.operators import factor as X, joins, regress as G, reshape


def test_twenty_thousand_points(spark):
    rng = np.random.default_rng(2)
    true = np.array([[0, 0], [6, 0], [0, 6], [6, 6]], float)
    home = rng.integers(0, 4, 20_000)
    xy = true[home] + rng.normal(size=(20_000, 2)) / 2
    points = spark.createDataFrame(pd.DataFrame({"x": xy[:, 0], "y": xy[:, 1], "n": rng.integers(1, 4, 20_000)}))
    held = X.condense(points, ["x", "y"], "n", 200).toPandas()
    assert 20 < len(held) <= 200 and held.n.sum() == points.agg(F.sum("n")).first()[0]
    assert np.allclose(np.average(held[["x", "y"]], axis=0, weights=held.n), np.average(xy, axis=0, weights=points.toPandas().n))
    fit = X.fit_clusters(points, ["x", "y"], condense_to=200)
    assert fit.converged and len(fit.centres) == 4
    assert max(np.abs(fit.centres - c).sum(1).min() for c in true) < 0.1


def test_few_points_stay_as_they_are(spark):
    rows = [(float(i % 5), float(i % 3), 1 + i % 2) for i in range(15)]
    points = spark.createDataFrame(rows, "x double, y double, n long")
    held = X.condense(points, ["x", "y"], "n", 1_000).toPandas()
    assert sorted(map(tuple, held.to_numpy())) == sorted((x, y, n) for x, y, n in rows)
    one = X.condense(points.withColumn("x", F.lit(1.0)).withColumn("y", F.lit(2.0)), ["x", "y"], "n", 5).collect()
    assert [tuple(r) for r in one] == [(1.0, 2.0, sum(n for *_, n in rows))]


def test_dominant_categories(spark):
    rows = [("a", "x", "g1", 8), ("b", "x", "g1", 1), ("a", "y", "g2", 1), ("b", "y", "g2", 8), ("a", "x", "g3", 5), ("b", "y", "g3", 5)]
    profiles = spark.createDataFrame(rows, "u string, v string, g string, n long")
    told = {r.cls: r for r in X.dominant_categories(X.describe_groups(profiles, ["u", "v"], "g")).collect()}
    assert told["g1"].name == "v=x" and told["g2"].name == "v=y" and told["g1"].leading == "v=x, u=a"
    assert told["g3"].name is None


def test_accent_blind_keys(spark):
    left = spark.createDataFrame([("Łódź",), ("Lodz",), ("Lódź",), ("lodz",), ("Ἀθῆναι",), (None,), ("",)], "k string")
    right = spark.createDataFrame([("Lódz", 1), ("Αθηναι", 2), ("Œuvre", 3), (None, 4), ("", 5)], "o string, v int")
    got = left.join(right, accent_blind("k") == accent_blind("o")).select("k", "v").collect()
    assert {(r.k, r.v) for r in got} == {("Łódź", 1), ("Lodz", 1), ("Lódź", 1), ("Ἀθῆναι", 2), ("", 5)}


def test_predicted_classes(spark):
    scored = spark.createDataFrame([(0.2, 1.0, 10.0), (0.5, 6.0, 12.0), (0.9, 9.0, 9.0)], "prediction double, s double, n double")
    got = {(r.predicted, r.actual): r.n for r in G.predicted_classes(scored).collect()}
    assert got == {(0, 1): 1, (0, 0): 9, (1, 1): 15, (1, 0): 6}


def test_list_difference_and_names_in_order(spark):
    left = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    right = spark.createDataFrame([("b",), ("c",), ("c",)], "k string")
    assert sorted(map(tuple, joins.list_difference(left, right, "k").collect())) == [("a", "left"), ("c", "right")]
    assert joins.list_difference(left.limit(0), right.limit(0), "k").count() == 0
    both = reshape.rename_in_order(spark.createDataFrame([(1, 2)], "x int, y int"), ["y", "x"])
    assert tuple(both.first()) == (1, 2) and both.columns == ["y", "x"]
    for names in (["a"], ["a", "A"]):
        with pytest.raises(ValueError):
            reshape.rename_in_order(both, names)
