"""Logistic fits with very many levels, and the derivatives behind the mixed models."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleanframe.operators import regress as G


def newton(x, y):
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ beta))
        h = (x * (p * (1 - p))[:, None]).T @ x
        beta = beta + np.linalg.solve(h, x.T @ (y - p))
    return beta, np.sqrt(np.diag(np.linalg.inv(h)))


def test_against_dense_newton(spark):
    rng = np.random.default_rng(8)
    n = 3_000
    lev, k, v = rng.integers(0, 12, n), rng.choice(list("pqr"), n), rng.normal(size=n).round(1)
    y = (rng.random(n) < 1 / (1 + np.exp(-(lev / 6 - 1 + 0.5 * v - 0.7 * (k == "q"))))).astype(int)
    pdf = pd.DataFrame({"lev": [f"l{i:02}" for i in lev], "k": k, "v": v, "y": y})
    alike = pd.DataFrame({"lev": ["all", "all", "none"], "k": ["p", "q", "p"], "v": [0.1, 0.2, 3.0], "y": [1, 1, 0]})
    hard = pd.DataFrame({"lev": [None, "l01"], "k": ["p", None], "v": [0.0, 1.0], "y": [1, 0]})
    df = spark.createDataFrame(pd.concat([pdf, alike, hard]).astype(object), "lev string, k string, v double, y int")
    got = G.wide_logit(df, "y", "lev", {"k": "p"}, ["v"]).toPandas()
    x = np.column_stack([np.ones(n), *[lev == i for i in range(1, 12)], v, k == "q", k == "r"]).astype(float)
    beta, se = newton(x, y)
    at = {(r.term, r.level): r for r in got.itertuples()}
    names = [("(Intercept)", "l00"), *[("lev", f"l{i:02}") for i in range(1, 12)]]
    assert np.allclose([at[k].estimate for k in names], beta[:12], atol=1e-8)
    assert np.allclose([at[k].std_error for k in names], se[:12], atol=1e-8)
    others = got[~got.term.isin(["(Intercept)", "lev"])].set_index("term")
    assert np.allclose(others.loc[["v", "k=q", "k=r"]].estimate, beta[12:], atol=1e-8)
    assert np.allclose(others.loc[["v", "k=q", "k=r"]].std_error, se[12:], atol=1e-8)
    assert at[("lev", "all")].separated and at[("lev", "none")].separated and np.isnan(at[("lev", "all")].estimate)
    assert got.separated.sum() == 2 and len(got) == 14 + 3


def test_twenty_thousand_levels(spark):
    """At the optimum residuals sum to zero in every level and along every other term."""
    rng = np.random.default_rng(9)
    n = 200_000
    lev, v = rng.integers(0, 20_000, n), rng.integers(0, 5, n)
    lev[: n // 3] = 7  # a third of all rows in one level
    y = (rng.random(n) < 1 / (1 + np.exp(-(np.sin(lev) + 0.3 * v - 0.5)))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"lev": lev, "v": v, "y": y}))
    fit = G.wide_logit(df, "y", "lev", numeric=["v"]).toPandas()
    assert len(fit) == len(np.unique(lev)) + 1
    slope = fit[fit.term == "v"].estimate.item()
    assert abs(slope - 0.3) < 0.05
    first = fit[fit.term == "(Intercept)"].estimate.item()
    a = pd.Series(np.where(fit.term == "(Intercept)", first, fit.estimate + first), index=fit.level)
    eta = a.reindex(lev.astype(str)).to_numpy() + slope * v
    rest = np.where(np.isnan(eta), 0.0, y - 1 / (1 + np.exp(-eta)))
    assert np.abs(np.bincount(lev, rest)).max() < 1e-6 and abs((rest * v).sum()) < 1e-6
    assert set(fit[fit.separated].level.astype(int)) == {i for i, m in pd.Series(y).groupby(lev).mean().items() if m in (0, 1)}


def test_terms_that_cannot_be_told_apart(spark):
    df = spark.createDataFrame([(i % 4, i % 4 % 2, int(i * 7 % 5 < 2)) for i in range(80)], "lev int, v int, y int")
    with pytest.raises(ValueError, match="determine"):
        G.wide_logit(df, "y", "lev", numeric=["v"])
    with pytest.raises(ValueError, match="both outcomes"):
        G.wide_logit(df.withColumn("y", F.lit(1)), "y", "lev")
    with pytest.raises(ValueError, match="both outcomes"):
        G.wide_logit(df.filter("false"), "y", "lev")


def test_derivatives_of_the_mixed_model():
    rng = np.random.default_rng(1)
    n = rng.integers(0, 9, (40, 3)).astype(float)
    s = np.floor(n * rng.random((40, 3)))
    design = np.eye(3)
    design[:, 0] = 1
    at, e = np.array([0.2, -0.5, 0.7, 0.8]), 1e-4
    f = lambda t: G.laplace_terms(s, n, design, t).sum()
    value, grad, hess = G.laplace_derivatives(s, n, design, at)
    assert value == pytest.approx(f(at))
    assert np.allclose(grad, [(f(at + d) - f(at - d)) / (2 * e) for d in np.eye(4) * e], atol=1e-5)
    rows = [[(f(at + a + b) - f(at + a - b) - f(at - a + b) + f(at - a - b)) / (4 * e * e) for b in np.eye(4) * e] for a in np.eye(4) * e]
    assert np.allclose(hess, rows, atol=1e-4)
    # standard errors to six digits: Hessian from differences of the exact gradient
    g = lambda t: G.laplace_derivatives(s, n, design, t)[1]
    by_gradient = np.array([(g(at + d) - g(at - d)) / (2 * e) for d in np.eye(4) * e])
    se = lambda h: np.sqrt(np.abs(np.diag(np.linalg.inv(-h))))
    assert np.allclose(se(hess), se(by_gradient), rtol=1e-6)
