"""Discriminants and classifiers of very many categories, and their hard rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleanframe.operators import factor as X


@pytest.fixture(scope="module")
def wide(spark):
    """5,000 categories in one variable, three in another, three classes."""
    rng = np.random.default_rng(3)
    n = 30_000
    a = rng.integers(0, 5_000, n)
    b = rng.choice(list("xyz"), n)
    lean = rng.random(5_000)[a] + np.where(b == "x", 0.5, 0.0) + rng.normal(size=n) / 3
    cls = np.where(lean < 0.5, "low", np.where(lean < 1.0, "mid", "top"))
    return spark.createDataFrame(pd.DataFrame({"a": [f"a{v}" for v in a], "b": b, "cls": cls}))


def test_five_thousand_categories(wide):
    """The score is the best linear one: its residual as a least-squares fit has mean zero in every category."""
    two = wide.withColumn("cls", F.when(F.col("cls") == "top", "top").otherwise("rest"))
    model = X.fit_discriminant(X.profile_counts(two, ["a", "b"], "cls"), ["a", "b"], "cls", "top")
    assert model.weights.count() == two.agg(F.count_distinct("a") + F.count_distinct("b")).first()[0]
    rows = model.scored(two.withColumn("y", (F.col("cls") == "top").cast("double"))).toPandas()
    assert rows.score.mean() == pytest.approx(0, abs=1e-9) and rows.score.var(ddof=0) == pytest.approx(1)
    slope = np.mean(rows.score * (rows.y - rows.y.mean()))
    assert slope > 0 and slope**2 / rows.y.var(ddof=0) == pytest.approx(model.ratio)
    rest = rows.y - rows.y.mean() - slope * rows.score
    for v in ("a", "b"):
        assert rest.groupby(rows[v]).mean().abs().max() < 1e-8


def test_three_classes_against_dense(spark, wide):
    """Few categories: the same classes as the pooled covariance gives by direct inversion."""
    rows = wide.withColumn("a", F.substring("a", 1, 2))
    profiles = X.profile_counts(rows, ["a", "b"], "cls")
    model = X.linear_classifier(profiles, ["a", "b"], "cls")
    got = model.predicted(profiles).toPandas()
    z = pd.get_dummies(got[["a", "b"]]).to_numpy(float)
    w, cls = got.n.to_numpy(float), got.cls.to_numpy()
    mu = {c: np.average(z[cls == c], axis=0, weights=w[cls == c]) for c in model.classes}
    within = sum(((z[cls == c] - mu[c]) * w[cls == c][:, None]).T @ (z[cls == c] - mu[c]) for c in model.classes) / (w.sum() - 3)
    inv = np.linalg.pinv(within, rcond=1e-10, hermitian=True)
    score = np.stack([z @ inv @ mu[c] - 0.5 * mu[c] @ inv @ mu[c] + np.log(w[cls == c].sum() / w.sum()) for c in model.classes], axis=1)
    assert (got.predicted == np.array(model.classes)[score.argmax(1)]).all()
    assert got.predicted.nunique() == 3
    # the expression and the joins tell the same
    again = profiles.withColumn("predicted", model.column()).toPandas()
    keys = ["a", "b", "cls"]
    assert again.sort_values(keys).predicted.tolist() == got.sort_values(keys).predicted.tolist()


def test_hard_rows(spark):
    rows = spark.createDataFrame([("p", "u", "1"), ("p", "v", "1"), ("q", "u", "2"), ("q", "v", "2"), (None, "u", "1")], "a string, b string, cls string")
    profiles = X.profile_counts(rows, ["a", "b"], "cls")
    # `a` parts the classes without exception, `b` not at all
    model = X.linear_classifier(profiles, ["a", "b"], "cls")
    told = model.predicted(rows.unionByName(spark.createDataFrame([("new", "u", "1")], rows.schema)))
    assert {(r.a, r.b): r.predicted for r in told.collect()} == {
        ("p", "u"): "1", ("p", "v"): "1", ("q", "u"): "2", ("q", "v"): "2", (None, "u"): None, ("new", "u"): None
    }
    assert told.count() == 6
    score = X.fit_discriminant(profiles, ["a", "b"], "cls", "2")
    assert score.ratio == pytest.approx(1.0)
    assert {r.a: round(r.score, 9) for r in score.scored(rows.dropna()).collect()} == {"p": -1.0, "q": 1.0}
    with pytest.raises(ArithmeticError):
        X.fit_discriminant(profiles, ["b"], "cls", "1")
    with pytest.raises(ValueError):
        X.fit_discriminant(profiles.filter("false"), ["a"], "cls", "1")


def test_scores_of_every_mention(spark, tmp_path):
    """A row for each distinct complete mention, though many share a profile, with the score of a least-squares fit."""
    from gleanframe.plans import QUERIES, load_all

    load_all()
    rng = np.random.default_rng(5)
    orders = [(o, o % 12, "OFP"[o % 3], ["1-URGENT", "2-HIGH", "5-LOW"][rng.integers(3)]) for o in range(80)]
    # no priority, no status, a customer that is not listed, no customer
    orders += [(80, 1, "O", None), (81, 2, None, "5-LOW"), (82, 99, "O", "5-LOW"), (83, None, "O", "5-LOW")]
    parts = [(p, f"Brand#{p}", ["TIN", "BRASS", None][p % 3]) for p in range(9)]
    lines = [(int(rng.integers(84)), int(rng.integers(9)), float(rng.integers(1, 4)), "R" if rng.random() < 0.4 else "N") for _ in range(600)]
    lines += lines[:50] + [(0, 0, None, "R"), (1, 0, 1.0, None), (2, 2, 1.0, "R"), (80, 0, 1.0, "R"), (82, 0, 1.0, "R"), (None, 0, 1.0, "R")]
    customers = [(c, c % 3, ["AUTOMOBILE", "BUILDING", None][c % 5 // 2], 0.0) for c in range(12)]
    tables = {
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"),
        "part": (parts, "p_partkey long, p_brand string, p_type string"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string"),
        "customer": (customers, "c_custkey long, c_nationkey long, c_mktsegment string, c_acctbal double"),
        "nation": ([(n, f"nation {n}", n % 2) for n in range(3)], "n_nationkey long, n_name string, n_regionkey long"),
        "region": ([(r, f"region {r}") for r in range(2)], "r_regionkey long, r_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    ordered, typed, listed = ({r[0]: r[1:] for r in t} for t in (orders, parts, customers))
    want = set()
    for o, p, pct, flag in lines:
        id, status, presence = ordered.get(o, (None, None, None))
        if id not in listed:
            continue
        nation, segment, _ = listed[id]
        variables = (presence, typed[p][1], status, segment, f"region {nation % 2}")
        if None not in variables:
            want.add((id, typed[p][0], "Unsustainable" if flag == "R" else "Sustainable", *variables, pct))

    variables = ["presence", "life_form", "status", "segment", "region"]
    got = QUERIES["dfa_scores"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) > len({r[2:8] for r in want})
    assert {(r.id, r.name, r.answer, *[r[v] for v in variables], r.range_pct) for r in got} == want

    z = pd.get_dummies(pd.DataFrame([[r[v] for v in variables] for r in got], columns=variables)).to_numpy(float)
    y = np.array([r.answer == "Unsustainable" for r in got], float)
    fitted = z @ np.linalg.lstsq(z, y, rcond=None)[0]
    assert [r.score for r in got] == pytest.approx((fitted - fitted.mean()) / fitted.std(), abs=1e-8)


def test_few_weights_are_sent_to_the_rows(spark):
    rows = spark.createDataFrame([("p", "u", "1"), ("p", "v", "2"), ("q", "u", "2"), ("q", "v", "2")], "a string, b string, cls string")
    model = X.fit_discriminant(X.profile_counts(rows, ["a", "b"], "cls"), ["a", "b"], "cls", "2")
    assert "SortMergeJoin" not in model.scored(rows)._jdf.queryExecution().executedPlan().toString()
