"""Distributed order against plain computation, with several partitions in play."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleanframe.operators import mentions as M, ordering as O, ranks


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    g = np.where(rng.random(4000) < 0.6, "hot", rng.choice(list("abc"), 4000))
    return pd.DataFrame({"g": g, "x": np.round(rng.gamma(2, 10, 4000), 1), "y": rng.integers(0, 2, 4000)})


@pytest.fixture
def df(spread, data):
    return spread.createDataFrame(data).repartition(7)


def test_prefix_sums_cross_partitions(spread, df, data):
    counts = O.value_counts(df, ["g"], "x")
    cum = O.prefix_sums(counts, ["g"], ["x"], ["n"])
    got = cum.toPandas().sort_values(["g", "x"])
    want = data.groupby(["g", "x"]).size().rename("n").reset_index().sort_values(["g", "x"])
    want["cum_n"] = want.groupby("g").n.cumsum()
    want["all_n"] = want.groupby("g").n.transform("sum")
    assert (got[["n", "cum_n", "all_n"]].to_numpy() == want[["n", "cum_n", "all_n"]].to_numpy()).all()


def test_prefix_sums_descending_and_null_group(spread):
    df = spread.createDataFrame([(None, 1, 2), (None, 2, 3), ("a", 1, 1)], "g string, k int, n int")
    got = {(r.g, r.k): r.cum_n for r in O.prefix_sums(df, ["g"], [F.desc("k")], ["n"]).collect()}
    assert got == {(None, 2): 3, (None, 1): 5, ("a", 1): 1}


def test_quantiles_match_numpy(df, data):
    got = {r.g: r for r in O.quantiles(df, ["g"], "x", {"q1": 0.25, "q2": 0.5, "q9": 0.9}).collect()}
    for g, x in data.groupby("g").x:
        assert np.allclose([got[g].q1, got[g].q2, got[g].q9], np.quantile(x, [0.25, 0.5, 0.9]))
        assert got[g].n == len(x)


def test_values_at_positions(spread, df, data):
    cum = O.prefix_sums(O.value_counts(df, ["g"], "x"), ["g"], ["x"], ["n"])
    sizes = data.groupby("g").size()
    asks = pd.DataFrame([(g, i, int(p)) for g, n in sizes.items() for i, p in enumerate([1, 2, n // 3, n // 2, n - 1, n])], columns=["g", "i", "at"])
    got = O.values_at_positions(cum, ["g"], "x", spread.createDataFrame(asks), "at").toPandas().set_index(["g", "i"]).x
    for g, i, at in asks.itertuples(index=False):
        assert got[(g, i)] == np.sort(data.x[data.g == g])[at - 1]


def test_top_with_ties_keeps_every_tie(spread):
    df = spread.createDataFrame([(i, v) for i, v in enumerate([9, 8, 7, 7, 7, 1, None])], "i int, v int")
    assert sorted(r.i for r in O.top_with_ties(df, "v", 3).collect()) == [0, 1, 2, 3, 4]
    assert O.top_with_ties(df, "v", 50).count() == 6


def test_cumulative_curve_and_cutoffs(spread):
    counts = spread.createDataFrame([("a", 50), ("b", 30), ("c", 10), ("d", 10)], "name string, citations bigint")
    curve = M.cumulative_frequency(counts)
    assert [(r.name, r.cum_percent, r["rank"]) for r in curve.orderBy("rank").collect()] == [
        ("a", 50.0, 1), ("b", 80.0, 2), ("c", 90.0, 3), ("d", 100.0, 4)
    ]
    assert sorted(tuple(r) for r in M.cumulative_cutoffs(curve).collect()) == [(50.0, 1), (80.0, 2), (95.0, 4)]
    assert M.knee_point(curve).first()["rank"] == 2


def _midranks(x):
    return pd.Series(x).rank().to_numpy()


def test_kruskal_wallis(df, data):
    r = _midranks(data.x)
    n = len(r)
    h = 12 / (n * (n + 1)) * sum(r[data.g == g].sum() ** 2 / (data.g == g).sum() for g in data.g.unique()) - 3 * (n + 1)
    t = data.x.value_counts().to_numpy().astype(float)
    h /= 1 - (t**3 - t).sum() / (n**3 - n)
    got = ranks.kruskal_wallis(df, "g", "x").first()
    assert np.isclose(got.statistic, h) and got.df == 3 and got.n == n
    assert np.isclose(got.eta2, (h - 3) / (n - 4))


def test_two_groups_are_the_rank_sum_test(df):
    two = df.filter(F.col("g").isin("a", "b"))
    h, z = ranks.kruskal_wallis(two, "g", "x").first(), ranks.dunn_pairs(two, "g", "x").first()
    assert np.isclose(h.statistic, z.statistic**2) and np.isclose(h.p, z.p) and z.p_adj == z.p


def test_bootstrap_follows_row_resampling(spread):
    rng = np.random.default_rng(3)
    values = {"odd": np.round(rng.normal(10, 3, 101), 1), "even": np.round(rng.normal(10, 3, 100), 1)}
    df = spread.createDataFrame([(g, float(x)) for g, v in values.items() for x in v], "g string, x double")
    got = {r.g: r for r in ranks.bootstrap_median(df, "g", "x").collect()}
    for g, v in values.items():
        meds = np.median(v[rng.integers(0, len(v), (20_000, len(v)))], axis=1)
        assert got[g].median == pytest.approx(np.median(v)) and got[g].n == len(v)
        assert abs(got[g].ci_low - np.quantile(meds, 0.025)) < 0.25 and abs(got[g].ci_high - np.quantile(meds, 0.975)) < 0.25
    again = {r.g: tuple(r) for r in ranks.bootstrap_median(df.repartition(3), "g", "x").collect()}
    assert again == {g: tuple(r) for g, r in got.items()}


def test_roc_equals_pair_counting(spread):
    rng = np.random.default_rng(1)
    s, y = rng.integers(0, 12, 200), rng.integers(0, 2, 200)
    df = spread.createDataFrame([(int(a), int(b)) for a, b in zip(s, y)], "s int, y int")
    got = ranks.roc_summary(ranks.score_counts(df, "s", F.col("y") == 1), "s").first()
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    assert np.isclose(got.auc, auc)
    gains = {t: (pos >= t).mean() + (neg < t).mean() for t in np.unique(s)}
    best = min(t for t in gains if np.isclose(gains[t], max(gains.values())))
    below = [t for t in np.unique(s) if t < best]
    assert got.threshold == ((best + max(below)) / 2 if below else -np.inf)


def test_boxplot_whiskers(spread):
    df = spread.createDataFrame([("g", float(x)) for x in [1, 2, 3, 4, 100]], "g string, x double")
    r = M.boxplot(df, ["g"], "x").first()
    assert (r.q1, r.median, r.q3, r.whisker_low, r.whisker_high) == (2.0, 3.0, 4.0, 1.0, 4.0)


def test_results_do_not_depend_on_partitioning(spread, data):
    base = spread.createDataFrame(data.rename(columns={"x": "name", "g": "area"}).assign(id=range(len(data)), answer=np.where(data.y, "Unsustainable", "Sustainable")))
    results = []
    for n in (1, 7):
        df = base.repartition(n)
        results.append(sorted(tuple(r) for r in M.mentions_by_area(df).collect()))
    assert results[0] == results[1]


def test_doubling_rows_leaves_ratios(spread):
    df = spread.createDataFrame([(1, "a", "Unsustainable", "f"), (2, "a", "Sustainable", "f"), (3, "b", "Sustainable", "f")], "id int, name string, answer string, life_form string")
    once = [tuple(r) for r in M.sustainability_ratio(df).collect()]
    assert once == [tuple(r) for r in M.sustainability_ratio(df.union(df)).collect()] == [("b", "f", 0.0, 1), ("a", "f", 0.5, 2)]
