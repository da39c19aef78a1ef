"""Logistic, mixed logistic and saturating-curve fits.

Rows collapse to weighted cells first. Objective sums run on the executors; the
driver keeps coefficient-sized vectors and matrices only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gleanframe.functions.tails import normal_two_sided
from gleanframe.session import materialise

COEFFICIENTS = "term string, estimate double, std_error double"


def cells(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    """Complete cases collapsed to (predictors, outcome) with a weight ``n``."""
    return df.select(outcome, *predictors).dropna("any").groupBy(outcome, *predictors).agg(F.count(F.lit(1)).alias("n"))


def levels_of(df: DataFrame, column: str, baseline: str | None = None) -> list[str]:
    """Sorted categories of a column, baseline first: one model term each, as its result has anyway."""
    found = sorted(r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().collect())
    if baseline is not None:
        found = [baseline] + [v for v in found if v != baseline]
    return found


def logit_model(df: DataFrame, outcome: str, categorical: dict[str, str | None], numeric: Sequence[str] = (), rounds: int = 50):
    """Fit a logistic regression of a 0/1 outcome with explicit baselines.

    Returns (model, terms, scored): ``scored`` holds one row per predictor cell with its
    trials ``n``, successes ``s`` and predicted probability ``prediction``. A fit that has not
    settled within ``rounds`` is an error.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    keys = [*categorical, *numeric]
    # grouped binomial cells: the success share with the trials as weight
    data = materialise(
        df.select(outcome, *keys).dropna("any").groupBy(*keys)
        .agg(F.sum(outcome).cast("double").alias("s"), F.count(F.lit(1)).alias("n"))
        .withColumn("share", F.col("s") / F.col("n"))
    )
    terms, exprs = [], []
    for c in numeric:
        terms.append(c)
        exprs.append(F.col(c).cast("double"))
    for c, baseline in categorical.items():
        for level in levels_of(data, c, baseline)[1:]:
            terms.append(f"{c}={level}")
            exprs.append((F.col(c) == level).cast("double"))
    names = [f"x{i}" for i in range(len(terms))]
    assembler = VectorAssembler(inputCols=names, outputCol="features")

    cells_in = assembler.transform(data.withColumns(dict(zip(names, exprs)))).drop(*names)
    glm = GeneralizedLinearRegression(
        family="binomial", link="logit", labelCol="share", weightCol="n", solver="irls", maxIter=rounds, tol=1e-12
    )
    model = glm.fit(cells_in)
    if model.summary.numIterations >= rounds:
        raise ArithmeticError(f"the logistic fit did not settle in {rounds} rounds")
    return model, terms, model.transform(cells_in).drop("features")


def coefficient_table(df: DataFrame, model, terms: Sequence[str]) -> DataFrame:
    summary = model.summary
    est = [float(model.intercept), *map(float, model.coefficients)]
    # the summary lists the intercept last
    se = list(map(float, summary.coefficientStandardErrors))
    rows = list(zip(["(Intercept)", *terms], est, [se[-1], *se[:-1]]))
    return with_tests(df.sparkSession.createDataFrame(rows, COEFFICIENTS))


def with_tests(coefs: DataFrame) -> DataFrame:
    z = F.try_divide("estimate", "std_error")
    return coefs.withColumn("z", z).withColumn("p", normal_two_sided("z"))


def fit_quality(scored: DataFrame, parameters: int) -> DataFrame:
    """Log-likelihood and AIC over the rows behind the scored cells."""
    s, n, p = F.col("s"), F.col("n"), F.col("prediction")
    return scored.agg(
        F.sum("n").alias("n"), F.sum(s * F.log(p) + (n - s) * F.log1p(-p)).alias("log_likelihood")
    ).withColumn("aic", 2 * parameters - 2 * F.col("log_likelihood"))


def predicted_classes(scored: DataFrame, threshold: float | Column = 0.5) -> DataFrame:
    """Confusion of a fitted model over the rows behind its scored cells: predicted, actual, n.

    The class is 1 where the predicted probability is at least the threshold.
    """
    at = F.lit(threshold) if isinstance(threshold, float) else threshold
    both = F.array(F.struct(F.lit(1).alias("actual"), F.col("s").alias("n")), F.struct(F.lit(0).alias("actual"), (F.col("n") - F.col("s")).alias("n")))
    told = scored.select((F.col("prediction") >= at).cast("int").alias("predicted"), F.inline(both))
    return told.groupBy("predicted", "actual").agg(F.sum("n").cast("bigint").alias("n"))


def odds_ratios(coefs: DataFrame, z: float = 1.96) -> DataFrame:
    """Odds ratio and Wald interval of every coefficient."""
    est, se = F.col("estimate"), F.col("std_error")
    return coefs.withColumns(
        {"odds_ratio": F.exp(est), "ci_low": F.exp(est - z * se), "ci_high": F.exp(est + z * se)}
    )


def wide_logit(
    df: DataFrame, outcome: str, wide: str, categorical: dict[str, str | None] | None = None, numeric: Sequence[str] = (),
    baseline=None, rounds: int = 50, tol: float = 1e-7,
) -> DataFrame:
    """Logistic regression with one predictor of any number of levels: term, level, estimate, std_error, n, separated.

    Levels of one predictor exclude each other, so their block of the information matrix is diagonal
    and Newton's equations reduce to those of the other terms: a round sums weights per level, solves
    for the other terms on the driver, and sets each level's own coefficient in Spark. Neither the
    levels nor a column per level reach the plan or the driver. ``categorical`` (with baselines) and
    ``numeric`` predictors are the other terms, so few that their square matrix is small.

    Rows with a null are left out. A level whose outcomes are all alike has no finite estimate: it is
    ``separated``, its numbers are null, and the other coefficients are those of the limit, which
    such a level does not touch. The baseline is the given level or the smallest that is not
    separated; ``(Intercept)`` is its log odds. A fit that has not settled in ``rounds``, other terms
    that determine each other or the level, and a separated baseline raise.
    """
    categorical, numeric = dict(categorical or {}), list(numeric)
    keys = [*categorical, *numeric]
    plain = df.select(F.col(wide).alias("__level"), F.col(outcome).cast("double").alias("__y"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    own = {k: f"__k{i}" for i, k in enumerate(keys)}
    counted = materialise(
        plain.dropna("any").groupBy("__level", *own.values()).agg(F.sum("__y").alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    )
    sized = counted.groupBy("__level").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    levels = materialise(sized.withColumn("separated", (F.col("s") == 0) | (F.col("s") == F.col("n"))))
    if baseline is None:
        baseline = levels.filter(~F.col("separated")).agg(F.min("__level")).first()[0]
        if baseline is None:
            raise ValueError("no level has both outcomes")
    elif levels.filter((F.col("__level") == baseline) & ~F.col("separated")).isEmpty():
        raise ValueError("the baseline must have both outcomes")
    terms, exprs = list(numeric), [F.col(own[c]).cast("double") for c in numeric]
    for c, base in categorical.items():
        for level in levels_of(counted, own[c], base)[1:]:
            terms.append(f"{c}={level}")
            exprs.append((F.col(own[c]) == level).cast("double"))
    m = len(terms)
    x, c = [f"x{i}" for i in range(m)], [f"c{i}" for i in range(m)]
    rows = counted.select("__level", "s", "n", *[e.alias(v) for e, v in zip(exprs, x)])
    now = levels.filter(~F.col("separated")).select("__level", F.log((F.col("s") + 0.5) / (F.col("n") - F.col("s") + 0.5)).alias("a"))
    pairs = [(i, j) for i in range(m) for j in range(i + 1)]
    beta, inverse = np.zeros(m), np.zeros((m, m))
    for _ in range(rounds):
        eta = sum((F.col(v) * float(b) for v, b in zip(x, beta)), F.col("a"))
        p = 1 / (1 + F.exp(-eta))
        rated = rows.join(now, "__level").withColumns({"e": F.col("s") - F.col("n") * p, "w": F.col("n") * p * (1 - p)})
        # the level's sums, and its part of the other terms' equations
        per_level = materialise(
            rated.groupBy("__level").agg(
                F.first("a").alias("a"), F.sum("w").alias("d"), F.sum("e").alias("g"), *[F.sum(F.col("w") * F.col(v)).alias(k) for v, k in zip(x, c)],
                *[F.sum(F.col("e") * F.col(v)).alias(f"g{i}") for i, v in enumerate(x)],
                *[F.sum(F.col("w") * F.col(x[i]) * F.col(x[j])).alias(f"a{i}_{j}") for i, j in pairs],
            )
        )
        move = np.zeros(m)
        if m:
            sums = per_level.agg(
                *[F.sum(F.col(f"g{i}") - F.col(c[i]) * F.col("g") / F.col("d")) for i in range(m)],
                *[F.sum(F.col(f"a{i}_{j}") - F.col(c[i]) * F.col(c[j]) / F.col("d")) for i, j in pairs],
                *[F.sum(f"a{i}_{i}") for i in range(m)],
            ).first()
            left = np.zeros((m, m))
            for k, (i, j) in enumerate(pairs):
                left[i, j] = left[j, i] = sums[m + k]
            whole = np.array(sums[m + len(pairs) :], float)
            if not whole.min() > 0 or np.linalg.eigvalsh(left / np.sqrt(np.outer(whole, whole)))[0] < 1e-10:
                raise ValueError(f"the terms {', '.join(terms)} determine each other or are determined by {wide}")
            inverse = np.linalg.inv(left)
            move = np.clip(inverse @ np.array(sums[:m], float), -5, 5)
        step = (F.col("g") - sum((F.col(k) * float(b) for k, b in zip(c, move)), F.lit(0.0))) / F.col("d")
        step = F.greatest(F.lit(-5.0), F.least(F.lit(5.0), step))
        moved = per_level.withColumn("step", step)
        largest = max(float(moved.agg(F.max(F.abs("step"))).first()[0]), np.abs(move).max(initial=0.0))
        beta = beta + move
        now = moved.select("__level", (F.col("a") + F.col("step")).alias("a"))
        if largest < tol:  # Newton squares the error: what is left is far smaller
            break
    else:
        raise ArithmeticError(f"the logistic fit did not settle in {rounds} rounds")
    # variance of a_l - a_0 from the block inverse: 1/d_l + 1/d_0 + (c_l/d_l - c_0/d_0)' S^-1 (c_l/d_l - c_0/d_0)
    fitted = now.join(per_level.select("__level", "d", *c), "__level")
    at = fitted.filter(F.col("__level") == baseline).first()
    base_c = [at[k] / at["d"] for k in c]

    def spread(gap: Sequence[Column]) -> Column:
        return sum((gap[i] * gap[j] * float(inverse[i, j]) for i in range(m) for j in range(m)), F.lit(0.0))

    is_base = F.col("__level") == baseline
    own_part = spread([F.col(k) / F.col("d") for k in c])
    gap_part = spread([F.col(k) / F.col("d") - float(b) for k, b in zip(c, base_c)])
    told = fitted.select(
        "__level",
        F.when(is_base, F.col("a")).otherwise(F.col("a") - float(at["a"])).alias("estimate"),
        F.sqrt(F.when(is_base, 1 / F.col("d") + own_part).otherwise(1 / F.col("d") + 1 / float(at["d"]) + gap_part)).alias("std_error"),
    )
    by_level = levels.join(told, "__level", "left").select(
        F.when(is_base, "(Intercept)").otherwise(F.lit(wide)).alias("term"), F.col("__level").cast("string").alias("level"), "estimate", "std_error",
        F.col("n").cast("bigint").alias("n"), "separated",
    )
    others = [(t, None, float(b), math.sqrt(v), None, False) for t, b, v in zip(terms, beta, np.diag(inverse))]
    return by_level.unionByName(df.sparkSession.createDataFrame(others, by_level.schema)) if others else by_level


# ---- mixed logistic models ---------------------------------------------------------


def _modes(s: np.ndarray, n: np.ndarray, base: np.ndarray, sigma: float) -> np.ndarray:
    u = np.zeros(len(s))
    for _ in range(50):
        p = 1 / (1 + np.exp(-(base + sigma * u[:, None])))
        step = (sigma * (s - n * p).sum(1) - u) / (sigma**2 * (n * p * (1 - p)).sum(1) + 1)
        u = u + np.clip(step, -2, 2)
        if np.abs(step).max(initial=0) < 1e-11:
            break
    return u


def laplace_terms(s: np.ndarray, n: np.ndarray, design: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Laplace log-likelihood of each level of a random-intercept logistic model.

    ``s``, ``n``: successes and trials, levels by cells. ``theta``: fixed effects then the
    deviation of the intercepts. The mode of each level is found by Newton steps on the
    standardised intercept.
    """
    base, sigma = design @ theta[:-1], theta[-1]
    u = _modes(s, n, base, sigma)
    eta = base + sigma * u[:, None]
    p = 1 / (1 + np.exp(-eta))
    fit = (s * eta - n * np.logaddexp(0, eta)).sum(1)
    return fit - u**2 / 2 - 0.5 * np.log1p(sigma**2 * (n * p * (1 - p)).sum(1))


def laplace_derivatives(s: np.ndarray, n: np.ndarray, design: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of ``laplace_terms`` with its gradient and Hessian in ``theta``.

    The mode u of a level follows the parameters: its first and second derivatives come from
    differentiating the condition that defines it, and enter those of the fit and of the
    curvature A at the mode.
    """
    beta, sigma = theta[:-1], theta[-1]
    u = _modes(s, n, design @ beta, sigma)
    eta = design @ beta + sigma * u[:, None]
    p = 1 / (1 + np.exp(-eta))
    w1 = n * p * (1 - p)
    w2, w3 = w1 * (1 - 2 * p), w1 * (1 - 6 * p + 6 * p * p)
    a = 1 + sigma**2 * w1.sum(1)
    value = (s * eta - n * np.logaddexp(0, eta)).sum(1) - u**2 / 2 - 0.5 * np.log(a)
    # g: derivative of a cell's predictor, levels by cells by parameters
    g = np.concatenate([np.broadcast_to(design, (*eta.shape, len(beta))), np.broadcast_to(u[:, None, None], (*eta.shape, 1))], axis=2)
    last = np.zeros(len(theta))
    last[-1] = 1.0
    both = lambda x, y: x[:, :, None] * y[:, None, :] + y[:, :, None] * x[:, None, :]
    along = lambda w: np.einsum("lj,ljp->lp", w, g)
    square = lambda w: np.einsum("lj,ljp,ljq->lpq", w, g, g)
    last_of = np.broadcast_to(last, (len(u), len(theta)))
    rest, g1, g2 = s - n * p, along(w1), along(w2)
    u1 = (rest.sum(1)[:, None] * last - sigma * g1) / a[:, None]
    a_theta = 2 * sigma * w1.sum(1)[:, None] * last + sigma**2 * g2
    a_u, a_uu = sigma**3 * w2.sum(1), sigma**4 * w3.sum(1)
    a_utheta = 3 * sigma**2 * w2.sum(1)[:, None] * last + sigma**3 * along(w3)
    a_theta2 = 2 * w1.sum(1)[:, None, None] * np.outer(last, last) + 2 * sigma * both(last_of, g2) + sigma**2 * square(w3)
    u1u1 = u1[:, :, None] * u1[:, None, :]
    h_theta2 = -both(last_of, g1) - sigma * square(w2)
    u2 = (h_theta2 - both(a_theta, u1) - a_u[:, None, None] * u1u1) / a[:, None, None]
    a1 = a_theta + a_u[:, None] * u1
    a2 = a_theta2 + both(a_utheta, u1) + a_uu[:, None, None] * u1u1 + a_u[:, None, None] * u2
    grad = along(rest) - 0.5 * a1 / a[:, None]
    h_utheta = u1 * a[:, None]
    hess = -square(w1) + h_utheta[:, :, None] * u1[:, None, :]
    hess = hess - 0.5 * (a2 / a[:, None, None] - a1[:, :, None] * a1[:, None, :] / (a * a)[:, None, None])
    return float(value.sum()), grad.sum(0), hess.sum(0)


def newton_with_derivatives(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], start: np.ndarray, rounds: int = 60):
    """Maximise a smooth function whose value, gradient and Hessian come together.

    One evaluation a round: a step that does not gain is halved. Returns (optimum, Hessian there,
    converged).
    """
    x = np.array(start, dtype=float)
    f, grad, hess = evaluate(x)
    move, length = None, 1.0
    for _ in range(rounds):
        if move is None:
            lam, vec = np.linalg.eigh(-hess)
            floor = max(1e-6, 1e-8 * np.abs(lam).max(initial=1.0))
            move = vec @ ((vec.T @ grad) / np.maximum(np.abs(lam), floor))
            largest = np.abs(move).max()
            if largest < 1e-8 * (1 + np.abs(x).max()):
                return x, hess, True
            length = min(1.0, 2.0 / largest)
        f_new, grad_new, hess_new = evaluate(x + length * move)
        if f_new >= f - 1e-13 * (1 + abs(f)):
            x, f, grad, hess, move = x + length * move, f_new, grad_new, hess_new, None
        elif length < 1e-6:
            return x, hess, bool(np.abs(grad).max() < 1e-3 * (1 + abs(f)))
        else:
            length /= 2
    return x, hess, False


def random_intercept_logit(
    df: DataFrame, outcome: str, predictor: str, level: str, baseline: str | None = None, singular_below: float = 1e-4
) -> DataFrame:
    """Logistic model with one categorical predictor and a random intercept per level.

    Rows become one record per level (successes and trials by predictor category). A Newton
    round is a Spark job: tasks sum the Laplace terms of their levels with gradient and Hessian,
    and the driver takes the step.
    """
    counts = cells(df, outcome, [predictor, level])
    cats = levels_of(counts, predictor, baseline)
    wins = F.col("n") * F.col(outcome)
    by_level = materialise(
        counts.groupBy(level).agg(
            F.array(*[F.coalesce(F.sum(F.when(F.col(predictor) == c, wins)), F.lit(0)).cast("double") for c in cats]).alias("s"),
            F.array(*[F.coalesce(F.sum(F.when(F.col(predictor) == c, F.col("n"))), F.lit(0)).cast("double") for c in cats]).alias("n"),
        )
    )
    k = len(cats)
    design = np.eye(k)
    design[:, 0] = 1.0

    def evaluate(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(1 + len(theta) + len(theta) ** 2)
            for pdf in batches:
                if len(pdf):
                    f, g, h = laplace_derivatives(np.stack(pdf.s.to_numpy()), np.stack(pdf.n.to_numpy()), design, theta)
                    total += np.concatenate([[f], g, h.ravel()])
            yield pd.DataFrame({"i": np.arange(len(total)), "f": total})

        rows = by_level.select("s", "n").mapInPandas(run, "i int, f double").groupBy("i").agg(F.sum("f").alias("f"))
        out = np.zeros(1 + len(theta) + len(theta) ** 2)
        for r in rows.collect():
            out[r.i] = r.f
        return out[0], out[1 : len(theta) + 1], out[len(theta) + 1 :].reshape(len(theta), -1)

    pooled = by_level.agg(
        *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(k)], *[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(k)]
    ).first()
    rate = np.array([(pooled[f"s{i}"] + 0.5) / (pooled[f"n{i}"] + 1.0) for i in range(k)])
    logit = np.log(rate / (1 - rate))
    start = np.concatenate([[logit[0]], logit[1:] - logit[0], [0.3]])
    theta, hess, converged = newton_with_derivatives(evaluate, start)
    sigma = abs(theta[-1])
    singular = sigma < singular_below
    # at the boundary the deviation is not free: invert the fixed-effect block alone
    info = -hess[:-1, :-1] if singular else -hess
    cov = np.linalg.pinv(info)
    terms = ["(Intercept)", *[f"{predictor}={c}" for c in cats[1:]]]
    rows = [(t, float(b), float(math.sqrt(max(cov[i, i], 0.0)))) for i, (t, b) in enumerate(zip(terms, theta))]
    coefs = with_tests(df.sparkSession.createDataFrame(rows, COEFFICIENTS))
    return coefs.withColumns(
        {"sd_level": F.lit(float(sigma)), "singular": F.lit(bool(singular)), "converged": F.lit(bool(converged))}
    )


MOR_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("observed_ratio", T.DoubleType()),
        T.StructField("pred_prob", T.DoubleType()),
        T.StructField("pred_prob_logit", T.DoubleType()),
        T.StructField("sd_area", T.DoubleType()),
        T.StructField("mor_area", T.DoubleType()),
        T.StructField("ci_lower", T.DoubleType()),
        T.StructField("ci_upper", T.DoubleType()),
        T.StructField("skipped", T.BooleanType()),
        T.StructField("singular", T.BooleanType()),
        T.StructField("converged", T.BooleanType()),
        T.StructField("reason_skipped", T.StringType()),
    ]
)


def _mor_of(name: str, pdf: pd.DataFrame) -> pd.DataFrame:
    s = pdf.unsustainable.to_numpy(float)[:, None]
    n = pdf.total_citations.to_numpy(float)[:, None]
    row = dict.fromkeys(MOR_SCHEMA.names)
    row["name"] = name
    row["observed_ratio"] = float(s.sum() / n.sum()) if n.sum() > 0 else None
    if len(pdf) < 2:
        row.update(skipped=True, reason_skipped="only 1 area")
    elif bool(((s == 0) | (s == n)).all()):
        row.update(skipped=True, reason_skipped="constant response")
    else:
        r = (s.sum() + 0.5) / (n.sum() + 1.0)
        one = np.ones((1, 1))
        fit = lambda theta: laplace_derivatives(s, n, one, theta)
        theta, _, settled = newton_with_derivatives(fit, np.array([math.log(r / (1 - r)), 0.5]))
        mu, sd = float(theta[0]), abs(float(theta[1]))
        logistic = lambda x: 1 / (1 + math.exp(-x))
        row.update(
            pred_prob_logit=mu, pred_prob=logistic(mu), sd_area=sd, mor_area=math.exp(math.sqrt(2 * sd * sd) * 0.6745),
            ci_lower=logistic(mu - 1.96 * sd), ci_upper=logistic(mu + 1.96 * sd), skipped=False, singular=sd < 1e-4, converged=settled,
        )
    return pd.DataFrame([row], columns=MOR_SCHEMA.names).astype({"skipped": bool})


def median_odds_ratios(area_cells: DataFrame) -> DataFrame:
    """One intercept-only mixed model per name over its areas.

    The input holds one count row per (area, name); a group is as long as the list of
    areas, whatever the number of mentions behind it.
    """
    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _mor_of(key[0], pdf)

    cols = area_cells.select("name", "unsustainable", "total_citations")
    return cols.groupBy("name").applyInPandas(fit, MOR_SCHEMA)


# ---- saturating curve ---------------------------------------------------------------


def saturating_fit(
    curve: DataFrame, x: str, y: str, a: float = 100.0, b: float = 0.05, rounds: int = 50, tol: float = 1e-9
) -> tuple[float, float]:
    """Least squares for ``y = a (1 - exp(-b x))`` by Gauss-Newton with step halving.

    A round is one aggregate: the sums at the whole step and at its halvings together.
    """
    curve = materialise(curve.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))

    def sums(points: list[tuple[float, float]]) -> list[dict]:
        # the trial parameters enter as one literal array: every round runs the same code
        trials = F.array(
            *[F.struct(F.lit(i).alias("i"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for i, (a, b) in enumerate(points)]
        )
        e = F.exp(-F.col("t.b") * F.col("x"))
        fa, fb = 1 - e, F.col("t.a") * F.col("x") * e
        r = F.col("y") - F.col("t.a") * fa
        pairs = {"aa": fa * fa, "ab": fa * fb, "bb": fb * fb, "ar": fa * r, "br": fb * r, "rss": r * r}
        rows = (
            curve.select("x", "y", F.explode(trials).alias("t"))
            .groupBy("t.i").agg(*[F.sum(v).alias(k) for k, v in pairs.items()])
        )
        return [r.asDict() for r in sorted(rows.collect(), key=lambda r: r.i)]

    now = sums([(a, b)])[0]
    for _ in range(rounds):
        det = now["aa"] * now["bb"] - now["ab"] ** 2
        if det == 0:
            break
        da = (now["bb"] * now["ar"] - now["ab"] * now["br"]) / det
        db = (now["aa"] * now["br"] - now["ab"] * now["ar"]) / det
        if abs(da) < tol * (1 + abs(a)) and abs(db) < tol * (1 + abs(b)):
            break
        tries = [(a + 0.5**k * da, b + 0.5**k * db) for k in range(8)]
        better = [(point, s) for point, s in zip(tries, sums(tries)) if s["rss"] <= now["rss"]]
        if not better:
            break
        (a, b), now = better[0]
    else:
        raise ArithmeticError(f"the curve did not settle in {rounds} rounds")
    return a, b


def saturating_prediction(x: Column, a: float, b: float) -> Column:
    return F.lit(a) * (1 - F.exp(-F.lit(b) * x))
