"""Model fits against direct matrix computation and known identities."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleanframe.functions import tails
from gleanframe.operators import factor as X, geo, regress as G
from gleanframe.sources.standins import mentions


@pytest.fixture(scope="module")
def survey():
    rng = np.random.default_rng(11)
    n = 600
    a = rng.choice(list("xyz"), n)
    b = np.where(rng.random(n) < 0.7, a, rng.choice(list("xyz"), n))
    c = rng.choice(["p", "q"], n)
    y = (rng.random(n) < np.where(b == "x", 0.75, 0.3)).astype(int)
    return pd.DataFrame({"id": range(n), "a": a, "b": b, "c": c, "y": y, "v": rng.normal(size=n).round(2), "s": rng.integers(0, 30, n)})


@pytest.fixture(scope="module")
def df(spark, survey):
    return spark.createDataFrame(survey)


VARS = ["a", "b", "c"]


def indicator(survey):
    return pd.get_dummies(survey[VARS]).astype(float)


def test_mca_is_the_svd_of_the_indicator_matrix(df, survey):
    z = indicator(survey).to_numpy()
    p = z / z.sum()
    r, c = p.sum(1), p.sum(0)
    u, s, vt = np.linalg.svd((p - np.outer(r, c)) / np.sqrt(np.outer(r, c)), full_matrices=False)
    model = X.fit_mca(X.profile_counts(df, VARS), VARS)
    k = len(model.eigenvalues)
    assert k == z.shape[1] - len(VARS)
    assert np.allclose(model.eigenvalues, s[:k] ** 2)
    assert np.isclose(model.eigenvalues.sum(), z.shape[1] / len(VARS) - 1)
    rows = X.mca_scores(df, model, axes=2).orderBy("id").toPandas()
    want = (u * s)[:, :2] / np.sqrt(r)[:, None]
    for a in range(2):
        got = rows[f"dim_{a + 1}"].to_numpy()
        assert np.allclose(np.abs(got), np.abs(want[:, a]), atol=1e-9)
        assert np.isclose(got.var(), model.eigenvalues[a])


def test_too_many_categories_are_refused(spark, monkeypatch):
    monkeypatch.setattr(X, "MAX_CATEGORIES", 5)
    df = spark.range(20).select(F.col("id").cast("string").alias("a"), F.lit("k").alias("b"))
    with pytest.raises(ValueError):
        X.fit_mca(X.profile_counts(df, ["a", "b"]), ["a", "b"])


def test_clusters_and_silhouette(df, survey):
    profiles = X.profile_counts(df, VARS)
    model = X.fit_mca(profiles, VARS)
    points = X.mca_scores(profiles, model, axes=2)
    clusters = X.fit_clusters(points, ["dim_1", "dim_2"])
    assert 3 <= len(clusters.centres) <= 10
    labelled = points.withColumn("cluster", clusters.label(model)).withColumn("pt", F.concat_ws("|", *VARS))
    # the category form of the distance agrees with the plain one
    assert labelled.filter(F.col("cluster") != X.nearest(["dim_1", "dim_2"], clusters.centres)).count() == 0
    pdf = labelled.toPandas()
    got = {b: X.silhouette_exact(labelled, "pt", ["dim_1", "dim_2"], "cluster", block=b).toPandas().set_index("pt").silhouette for b in (3, 4000)}
    xy = np.repeat(pdf[["dim_1", "dim_2"]].to_numpy(), pdf.n, axis=0)
    cl, name = np.repeat(pdf.cluster.to_numpy(), pdf.n), np.repeat(pdf.pt.to_numpy(), pdf.n)
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    for i in range(0, len(xy), 37):
        own = cl == cl[i]
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][cl == k].mean() for k in set(cl) - {cl[i]})
        for g in got.values():
            assert g[name[i]] == pytest.approx((b - a) / max(a, b))


def test_condensed_clustering_runs_past_the_exact_size(df):
    profiles = X.profile_counts(df, VARS)
    points = X.mca_scores(profiles, X.fit_mca(profiles, VARS), axes=2)
    clusters = X.fit_clusters(points, ["dim_1", "dim_2"], condense_to=8)
    assert 3 <= len(clusters.centres) <= 8


def test_discriminant_score(df, survey):
    rows = df.withColumn("cls", F.when(F.col("y") == 1, "bad").otherwise("good"))
    profiles = X.profile_counts(rows, VARS, "cls")
    model = X.fit_discriminant(profiles, VARS, "cls", "bad")
    s = rows.select("id", "y", model.score().alias("s")).orderBy("id").toPandas()
    assert np.isclose(s.s.mean(), 0, atol=1e-9) and np.isclose(s.s.var(ddof=0), 1)
    assert s.s[s.y == 1].mean() > 0
    # no linear score separates the classes better: compare with least squares on the indicators
    z = indicator(survey).to_numpy()
    z1 = np.column_stack([np.ones(len(z)), z])
    fit = z1 @ np.linalg.lstsq(z1, survey.y.to_numpy().astype(float), rcond=None)[0]
    assert np.corrcoef(fit, s.s)[0, 1] == pytest.approx(1.0)
    loadings = {(r.variable, r.category): r.correlation for r in X.discriminant_loadings(df.sparkSession, model).collect()}
    assert loadings[("b", "x")] == pytest.approx(np.corrcoef(survey.b == "x", s.s)[0, 1])


def test_linear_classifier(df, survey):
    rows = df.withColumn("cls", F.when(F.col("y") == 1, "bad").otherwise("good"))
    predicted = X.fit_linear_classifier(X.profile_counts(rows, VARS, "cls"), VARS, "cls")
    got = rows.select("id", predicted.alias("p")).orderBy("id").toPandas().p.to_numpy()
    z, y = indicator(survey).to_numpy(), survey.y.to_numpy()
    mu = np.array([z[y == k].mean(0) for k in (0, 1)])
    within = sum((z[y == k] - mu[k]).T @ (z[y == k] - mu[k]) for k in (0, 1)) / (len(z) - 2)
    inv = np.linalg.pinv(within, rcond=1e-10, hermitian=True)
    score = [z @ inv @ mu[k] - 0.5 * mu[k] @ inv @ mu[k] + math.log((y == k).mean()) for k in (0, 1)]
    assert (got == np.where(score[1] > score[0], "bad", "good")).mean() == 1.0


def newton_logit(x, y):
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        h = (x * (p * (1 - p))[:, None]).T @ x
        beta = beta + np.linalg.solve(h, x.T @ (y - p))
    return beta, np.sqrt(np.diag(np.linalg.inv(h))), (y * np.log(p) + (1 - y) * np.log1p(-p)).sum()


def test_logistic_regression(df, survey):
    model, terms, scored = G.logit_model(df, "y", {"b": "y"}, ["v"])
    assert terms == ["v", "b=x", "b=z"]
    x = np.column_stack([np.ones(len(survey)), survey.v, survey.b == "x", survey.b == "z"]).astype(float)
    beta, se, loglik = newton_logit(x, survey.y.to_numpy())
    got = G.odds_ratios(G.coefficient_table(df, model, terms)).toPandas()
    assert np.allclose(got.estimate, beta, atol=1e-6) and np.allclose(got.std_error, se, atol=1e-5)
    assert np.allclose(got.ci_low, np.exp(beta - 1.96 * se), rtol=1e-4)
    q = G.fit_quality(scored, 4).first()
    assert q.log_likelihood == pytest.approx(loglik) and q.aic == pytest.approx(8 - 2 * loglik) and q.n == len(survey)


def brute_marginal(s, n, design, theta):
    """Log-likelihood by dense quadrature, without the Laplace step."""
    u = np.linspace(-8, 8, 4001)
    w = np.exp(-u * u / 2) / math.sqrt(2 * math.pi) * (u[1] - u[0])
    total = 0.0
    for a, b in zip(s, n):
        eta = (design @ theta[:-1])[:, None] + theta[-1] * u
        total += math.log((np.exp((a[:, None] * eta - b[:, None] * np.logaddexp(0, eta)).sum(0)) * w).sum())
    return total


def test_laplace_is_close_to_quadrature():
    rng = np.random.default_rng(2)
    n = rng.integers(5, 40, (12, 2)).astype(float)
    s = rng.binomial(n.astype(int), 0.4).astype(float)
    design = np.array([[1.0, 0.0], [1.0, 1.0]])
    theta = np.array([-0.4, 0.2, 0.6])
    assert G.laplace_terms(s, n, design, theta).sum() == pytest.approx(brute_marginal(s, n, design, theta), abs=0.2)
    zero = np.array([-0.4, 0.2, 0.0])
    assert G.laplace_terms(s, n, design, zero).sum() == pytest.approx(brute_marginal(s, n, design, zero), abs=1e-8)


def test_mixed_model_recovers_its_inputs(spark):
    rng = np.random.default_rng(8)
    levels, per = 120, 40
    b = rng.normal(0, 0.8, levels)
    lev = np.repeat(np.arange(levels), per)
    grp = rng.choice(["p", "q"], levels * per)
    y = rng.random(levels * per) < 1 / (1 + np.exp(-(-0.5 + 0.9 * (grp == "q") + b[lev])))
    pdf = pd.DataFrame({"y": y.astype(int), "grp": grp, "lev": [f"L{i}" for i in lev]})
    got = G.random_intercept_logit(spark.createDataFrame(pdf), "y", "grp", "lev", "p").toPandas()
    assert got.converged.all() and not got.singular.any()
    assert abs(got.estimate[1] - 0.9) < 0.2 and abs(got.sd_level[0] - 0.8) < 0.2 and 0.03 < got.std_error[1] < 0.12


def test_mixed_model_without_level_effect_is_the_plain_one(df, survey):
    flat = df.withColumn("lev", F.lit("one"))
    got = G.random_intercept_logit(flat, "y", "c", "lev", "p").toPandas()
    p = survey.groupby("c").y.mean()
    want = math.log(p["q"] / (1 - p["q"])) - math.log(p["p"] / (1 - p["p"]))
    assert got.singular.all() and got.estimate[1] == pytest.approx(want, abs=1e-4)


def test_median_odds_ratio_and_skips(spark):
    rng = np.random.default_rng(4)
    rows = [("one area", 1, 2), ("flat", 0, 3), ("flat", 2, 2)]
    u = 1 / (1 + np.exp(-rng.normal(-0.3, 1.0, 60)))
    rows += [("varied", int(rng.binomial(50, p)), 50) for p in u]
    got = {r.name: r for r in G.median_odds_ratios(spark.createDataFrame(rows, "name string, unsustainable int, total_citations int")).collect()}
    assert got["one area"].reason_skipped == "only 1 area" and got["flat"].reason_skipped == "constant response"
    v = got["varied"]
    assert not v.skipped and abs(v.sd_area - 1.0) < 0.35
    assert v.mor_area == pytest.approx(math.exp(math.sqrt(2) * v.sd_area * 0.6745))
    assert v.ci_lower < v.pred_prob < v.ci_upper


def test_saturating_curve(spark):
    x = np.arange(1, 60)
    df = spark.createDataFrame([(int(i), float(90 * (1 - math.exp(-0.08 * i)))) for i in x], "x int, y double")
    a, b = G.saturating_fit(df, "x", "y")
    assert a == pytest.approx(90) and b == pytest.approx(0.08)


def test_tails():
    assert tails.gamma_upper(2, 3) == pytest.approx(math.exp(-3) * 4)
    assert tails.gamma_upper(0.5, 1.920729) == pytest.approx(0.05, abs=1e-6)
    assert tails.normal_quantile(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert tails.beta_lower(2, 3, 0.4) == pytest.approx(0.5248)
    # the exact interval of 7 successes in 20 trials
    assert tails.beta_quantile(0.025, 7, 14) == pytest.approx(0.15391, abs=1e-5)
    assert tails.beta_quantile(0.975, 8, 13) == pytest.approx(0.59219, abs=1e-5)


def test_dissolve_keeps_area_and_finds_the_hole(spark):
    # a 3x3 block with the middle square owned by someone else
    cells = [("out" if (i, j) != (1, 1) else "in", float(i), float(j)) for i in range(3) for j in range(3)]
    df = spark.createDataFrame(cells, "owner string, x double, y double")
    df = df.select("owner", geo.square(F.col("x"), F.col("y"), 1.0).alias("rings"))
    outline = geo.dissolve_edges(df, ["owner"])
    assert {r.owner: r.n for r in outline.groupBy("owner").agg(F.count("x0").alias("n")).collect()} == {"out": 16, "in": 4}
    rings = geo.outline_rings(outline, ["owner"])
    got = sorted(tuple(r) for r in rings.groupBy("owner", "ring").agg(F.count("seq").alias("n"), F.max("seq").alias("m")).select("owner", "n", "m").collect())
    assert got == [("in", 4, 4), ("out", 4, 4), ("out", 12, 12)]
    area = rings.groupBy("owner").agg((F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2).alias("a"))
    want = {r.owner: (r.area, r.cx, r.cy) for r in geo.area_and_centroid(df, ["owner"]).collect()}
    assert {r.owner: r.a for r in area.collect()} == {k: v[0] for k, v in want.items()} == {"out": 8.0, "in": 1.0}
    assert want["out"][1:] == pytest.approx((1.5, 1.5))
    # following seq walks each ring edge to edge
    p = rings.withColumn("ring", F.col("ring").cast("string")).toPandas().sort_values(["owner", "ring", "seq"])
    for _, r in p.groupby(["owner", "ring"]):
        ends, starts = r[["x1", "y1"]].to_numpy(), np.roll(r[["x0", "y0"]].to_numpy(), -1, axis=0)
        assert (ends == starts).all()


def test_mentions_scan_only_what_they_need(spark):
    plan = mentions(spark, "/root/testdata/sf0.001", "name", "answer")._jdf.queryExecution().toString()
    assert "supplier" not in plan and "orders" not in plan and "l_extendedprice" not in plan.split("Physical Plan")[-1]
