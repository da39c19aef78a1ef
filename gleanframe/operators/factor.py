"""Correspondence, cluster and discriminant analysis of categorical profiles.

Rows are reduced to counts per distinct profile, then to counts per category pair.
Only category-by-category matrices reach the driver, behind a size check; scores go
back to the rows as column expressions. Discriminants have no such bound.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleanframe.functions.tails import chi2_upper, hypergeometric_test
from gleanframe.session import materialise, written

#: What ``fit_mca`` puts on the driver; ``leading_axes`` has no such bound.
MAX_CATEGORIES = 2_000


def profile_counts(df: DataFrame, variables: Sequence[str], *more: str) -> DataFrame:
    """Complete cases collapsed to distinct profiles with a weight ``n``."""
    keys = [*variables, *more]
    return df.select(*keys).dropna("any").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def burt_counts(profiles: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Weighted counts of category pairs: ``var1, cat1, var2, cat2, n``."""
    cats = F.array(*[F.struct(F.lit(v).alias("var"), F.col(v).alias("cat")) for v in variables])
    pairs = F.flatten(F.transform(cats, lambda a: F.transform(cats, lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = profiles.select("n", F.explode(pairs).alias("p"))
    return rows.groupBy(
        F.col("p.a.var").alias("var1"), F.col("p.a.cat").alias("cat1"),
        F.col("p.b.var").alias("var2"), F.col("p.b.cat").alias("cat2"),
    ).agg(F.sum("n").alias("n"))


def class_counts(profiles: DataFrame, variables: Sequence[str], group: str) -> DataFrame:
    """Weighted counts of (category, class)."""
    cats = F.explode(F.array(*[F.struct(F.lit(v).alias("var"), F.col(v).alias("cat")) for v in variables]))
    rows = profiles.select(F.col(group).alias("cls"), "n", cats.alias("c"))
    return rows.groupBy("c.var", "c.cat", "cls").agg(F.sum("n").alias("n"))


def _burt_matrix(profiles: DataFrame, variables: Sequence[str]):
    burt = burt_counts(profiles, variables)
    cap = MAX_CATEGORIES**2
    cells = burt.limit(cap + 1).toPandas()
    keys = sorted(set(zip(cells.var1, cells.cat1)))
    if len(cells) > cap or len(keys) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories: not categorical variables")
    pos = {k: i for i, k in enumerate(keys)}
    b = np.zeros((len(keys), len(keys)))
    b[[pos[k] for k in zip(cells.var1, cells.cat1)], [pos[k] for k in zip(cells.var2, cells.cat2)]] = cells.n
    return keys, b


@dataclass
class Mca:
    """Axes of a multiple correspondence analysis."""

    variables: list[str]
    categories: list[tuple[str, str]]
    burt: np.ndarray
    masses: np.ndarray
    eigenvalues: np.ndarray
    vectors: np.ndarray

    @property
    def n(self) -> float:
        return float(np.trace(self.burt)) / len(self.variables)

    def weights(self, axes: int) -> np.ndarray:
        """Category weights whose sum over a row's categories is the row's score."""
        return self.vectors[:, :axes] / (len(self.variables) * np.sqrt(self.masses)[:, None])


def fit_mca(profiles: DataFrame, variables: Sequence[str]) -> Mca:
    """Eigen-analysis of the category-pair matrix; all axes of positive inertia.

    The matrix is on the driver: use ``leading_axes`` for columns of very many categories.
    Signs are fixed so that the largest loading of an axis is positive.
    """
    keys, b = _burt_matrix(profiles, variables)
    q = len(variables)
    n = np.trace(b) / q
    c = np.diag(b) / (n * q)
    root = np.sqrt(c)
    s = b / (n * q * q) / np.outer(root, root) - np.outer(root, root)
    lam, v = np.linalg.eigh((s + s.T) / 2)
    order = np.argsort(-lam)
    lam, v = lam[order], v[:, order]
    keep = lam > 1e-10
    lam, v = lam[keep], v[:, keep]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), range(v.shape[1])])
    return Mca(list(variables), keys, b, c, lam, v)


def leading_axes(
    profiles: DataFrame, variables: Sequence[str], axes: int = 2, rounds: int = 100, tol: float = 1e-8
) -> tuple[DataFrame, np.ndarray, bool]:
    """The first axes for any number of categories: (vectors, eigenvalues, converged).

    Subspace iteration on the sparse category-pair counts, which stay in Spark: a round is a join
    of cells with the vectors and a sum per category. The driver holds matrices of ``axes`` + 4
    rows and columns only. ``vectors`` has ``var, cat, mass, v_1..v_axes``, the same vectors as
    ``fit_mca`` up to sign.
    """
    q, width = len(variables), axes + 4
    cells = materialise(burt_counts(profiles, variables))
    diagonal = cells.filter("var1 = var2 and cat1 = cat2")
    n = float(diagonal.agg(F.sum("n")).first()[0]) / q
    names = [f"v_{i + 1}" for i in range(width)]
    start = [(F.xxhash64("var1", "cat1", F.lit(i)) % 10_007).cast("double") / 10_007 for i in range(width)]
    now = materialise(
        diagonal.select(
            F.col("var1").alias("var"), F.col("cat1").alias("cat"), (F.col("n") / (n * q)).alias("mass"), *[s.alias(v) for s, v in zip(start, names)]
        )
    )
    root = F.sqrt("mass")

    def gram(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> np.ndarray:
        cells_of = [F.sum(F.col(a) * F.col(b)) for a in left for b in right]
        return np.array(df.agg(*cells_of).first(), float).reshape(len(left), len(right))

    def combined(df: DataFrame, by: np.ndarray, of: Sequence[str]) -> list[Column]:
        return [sum((F.col(a) * float(by[k, i]) for k, a in enumerate(of)), F.lit(0.0)).alias(names[i]) for i in range(by.shape[1])]

    before, values, settled = np.full(axes, np.inf), np.zeros(axes), False
    images = [f"s_{v}" for v in names]
    for _ in range(rounds):
        # orthonormal vectors, then their images under the centred matrix
        low = np.linalg.cholesky(gram(now, names, names) + 1e-300 * np.eye(width))
        now = now.select("var", "cat", "mass", *combined(now, np.linalg.inv(low).T, names))
        along = now.agg(*[F.sum(root * F.col(v)) for v in names]).first()
        side = now.select(F.col("var").alias("var2"), F.col("cat").alias("cat2"), *[(F.col(v) / root).alias(v) for v in names])
        summed = cells.join(side, ["var2", "cat2"]).groupBy("var1", "cat1").agg(*[F.sum(F.col("n") * F.col(v)).alias(s) for v, s in zip(names, images)])
        summed = summed.withColumnsRenamed({"var1": "var", "cat1": "cat"})
        now = now.join(summed, ["var", "cat"]).select(
            "var", "cat", "mass", *names,
            *[(F.col(s) / (n * q * q) / root - root * F.lit(float(a or 0.0))).alias(s) for s, a in zip(images, along)],
        )
        now = materialise(now)
        lam, turn = np.linalg.eigh((h := gram(now, names, images)) / 2 + h.T / 2)
        lam, turn = lam[::-1], turn[:, ::-1]
        values = lam[:axes]
        settled = bool(np.abs(values - before).max() <= tol * max(1.0, np.abs(values).max()))
        if settled:
            now = now.select("var", "cat", "mass", *combined(now, turn, names))
            break
        before = values
        now = now.select("var", "cat", "mass", *[F.col(s).alias(v) for s, v in zip(images, names)])
    return now.select("var", "cat", "mass", *names[:axes]), values, settled


def mca_eigen(spark: SparkSession, model: Mca) -> DataFrame:
    lam = model.eigenvalues
    pct = 100 * lam / lam.sum()
    rows = [(i + 1, float(a), float(p), float(s)) for i, (a, p, s) in enumerate(zip(lam, pct, pct.cumsum()))]
    return spark.createDataFrame(rows, "axis int, eigenvalue double, percent double, cum_percent double")


def mca_categories(spark: SparkSession, model: Mca, axes: int = 5) -> DataFrame:
    """Coordinate and contribution (percent) of every category on the first axes."""
    lam, v = model.eigenvalues[:axes], model.vectors[:, :axes]
    coord = v * np.sqrt(lam) / np.sqrt(model.masses)[:, None]
    rows = [
        (var, cat, a + 1, float(coord[k, a]), float(100 * v[k, a] ** 2))
        for k, (var, cat) in enumerate(model.categories)
        for a in range(v.shape[1])
    ]
    return spark.createDataFrame(rows, "variable string, category string, axis int, coord double, contrib double")


def weighted_sum(variables: Sequence[str], categories: Sequence[tuple[str, str]], weights: np.ndarray) -> Column:
    """Row-wise sum of category weights as one column expression."""
    total = None
    for v in variables:
        pairs = [(c, float(w)) for (var, c), w in zip(categories, weights) if var == v]
        table = F.create_map(*[F.lit(x) for p in pairs for x in p])
        term = F.try_element_at(table, F.col(v))
        total = term if total is None else total + term
    return total


def mca_scores(df: DataFrame, model: Mca, axes: int = 5) -> DataFrame:
    """Add ``dim_1..dim_k``; a narrow projection, rows keep their keys."""
    w = model.weights(axes)
    return df.withColumns(
        {f"dim_{a + 1}": weighted_sum(model.variables, model.categories, w[:, a]) for a in range(w.shape[1])}
    )


# ---- clustering -------------------------------------------------------------------


def _ward(points: np.ndarray, weights: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges of weighted Ward clustering (slot kept, slot freed, inertia added)."""
    x, w = points.copy(), weights.astype(float).copy()
    alive = np.ones(len(x), dtype=bool)
    total = w.sum()
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1) * (w[:, None] * w[None, :] / (w[:, None] + w[None, :])) / total
    np.fill_diagonal(d, np.inf)
    merges = []
    for _ in range(len(x) - 1):
        i, j = divmod(int(d.argmin()), len(x))
        merges.append((i, j, float(d[i, j])))
        x[i] = (w[i] * x[i] + w[j] * x[j]) / (w[i] + w[j])
        w[i] += w[j]
        alive[j] = False
        d[j, :] = d[:, j] = np.inf
        others = alive.copy()
        others[i] = False
        row = ((x - x[i]) ** 2).sum(1) * (w * w[i] / (w + w[i])) / total
        d[i, :] = d[:, i] = np.where(others, row, np.inf)
    return merges


def _cut(merges, n: int, smallest: int, largest: int) -> int:
    """Number of clusters at the largest relative drop of within inertia."""
    within = np.concatenate([[0.0], np.cumsum([m[2] for m in merges])])[::-1]  # within[q - 1]: q clusters
    tries = range(max(2, smallest), min(largest, n - 1) + 1)
    drops = {q: within[q - 1] / within[q - 2] for q in tries if within[q - 2] > 0}
    return min(drops, key=drops.get) if drops else min(n, smallest)


def _centres(points, weights, merges, k: int) -> np.ndarray:
    label = np.arange(len(points))
    for i, j, _ in merges[: len(points) - k]:
        label[label == j] = i
    return np.array([np.average(points[label == g], axis=0, weights=weights[label == g]) for g in np.unique(label)])


def nearest(dims: Sequence[str], centres: np.ndarray) -> Column:
    """1-based index of the closest centre, the centres being one literal array."""
    table = F.array(
        *[
            F.struct(F.lit(i + 1).alias("i"), F.array(*[F.lit(float(c)) for c in row]).alias("c"))
            for i, row in enumerate(centres)
        ]
    )
    point = F.array(*dims)

    def to_point(t: Column) -> Column:
        squares = F.zip_with(t["c"], point, lambda a, b: (a - b) * (a - b))
        return F.struct(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v).alias("d"), t["i"].alias("i"))

    return F.array_min(F.transform(table, to_point))["i"]


@dataclass
class Clusters:
    """Cluster centres on the first axes of an analysis."""

    dims: list[str]
    centres: np.ndarray
    converged: bool

    def label(self, model: Mca) -> Column:
        """1-based cluster of a row, straight from its categories.

        Scores are sums of category weights, so the squared distance to a centre, less the
        part all centres share, is one such sum too.
        """
        w = model.weights(len(self.dims))
        dist = [
            F.lit(float(c @ c)) - 2 * weighted_sum(model.variables, model.categories, w @ c) for c in self.centres
        ]
        # rounded, so that rows of one profile never split on the last digit
        return F.array_min(F.array(*[F.struct(F.round(d, 12).alias("d"), F.lit(i + 1).alias("i")) for i, d in enumerate(dist)]))["i"]


def condense(points: DataFrame, dims: Sequence[str], weight: str, at_most: int) -> DataFrame:
    """Weighted centres of the occupied cells of a grid: the dims and ``weight``, at most ``at_most`` rows.

    The finest of a ladder of grids whose cells are so few is taken. A cell's weight and weighted sums
    add up over any parts of the points; fewer distinct points than ``at_most`` stay as they are
    (apart from points nearer than a millionth of the range).
    """
    ends = points.agg(*[f(d) for d in dims for f in (F.min, F.max)]).first()
    low, width = list(ends[::2]), [b - a for a, b in zip(ends[::2], ends[1::2])]
    ladder = [1, *dict.fromkeys(round(2 ** (t / 2)) for t in range(2, 41))]

    def cell(parts: int) -> list[Column]:
        return [F.least(F.floor((F.col(d) - a) / w * parts), F.lit(parts - 1)) if w > 0 else F.lit(0) for d, a, w in zip(dims, low, width)]

    keys = [f"__c{i}" for i in range(len(dims))]

    def celled(at: int) -> DataFrame:
        return points.withColumns(dict(zip(keys, cell(ladder[at])))).groupBy(*keys).agg(
            *[(F.sum(F.col(d) * F.col(weight)) / F.sum(weight)).alias(d) for d in dims], F.sum(weight).alias(weight)
        )

    # halving over the ladder; the coarsest grid is one cell
    fits, above = 0, len(ladder)
    while above - fits > 1:
        middle = (fits + above) // 2 if above < len(ladder) else above - 1
        if celled(middle).count() <= at_most:
            fits = middle
        else:
            above = middle
    return celled(fits).drop(*keys)


def fit_clusters(
    points: DataFrame, dims: Sequence[str], weight: str = "n", smallest: int = 3, largest: int = 10,
    condense_to: int = 1_000, rounds: int = 10,
) -> Clusters:
    """Ward clustering with an automatic cut, then weighted k-means rounds from its centres.

    ``points`` holds score points with weights. They are condensed into at most ``condense_to`` weighted
    centres, whatever their count, which go to Ward on the driver; the k-means rounds run over all
    points in Spark. ``converged`` says whether the last rounds still moved the centres.
    """
    dims = list(dims)
    points = materialise(points.select(*dims, F.col(weight).cast("double").alias("w")))
    held = condense(points, dims, "w", condense_to).toPandas().sort_values(dims)
    x, w = held[dims].to_numpy(), held.w.to_numpy()
    merges = _ward(x, w)
    centres, settled = _centres(x, w, merges, _cut(merges, len(x), smallest, largest)), False
    for _ in range(rounds):
        means = (
            points.withColumn("cluster", nearest(dims, centres)).groupBy("cluster")
            .agg(*[(F.sum(F.col(d) * F.col("w")) / F.sum("w")).alias(d) for d in dims]).toPandas()
        )
        moved = means.sort_values("cluster")[dims].to_numpy()
        if moved.shape == centres.shape and np.allclose(moved, centres, atol=1e-10):
            settled = True
            break
        centres = moved
    return Clusters(dims, centres[np.lexsort(centres.T[::-1])], settled)


def describe_groups(profiles: DataFrame, variables: Sequence[str], group: str) -> DataFrame:
    """Over- and under-representation of categories in groups.

    Per (category, group): share within the group, overall share, and the test value
    (count against its hypergeometric mean, in standard deviations); per variable the
    chi-squared statistic of its association with the groups.
    """
    from gleanframe.operators.joins import enrich

    cells = class_counts(profiles, variables, group)
    by_cat = cells.groupBy("var", "cat").agg(F.sum("n").alias("n_cat"))
    by_cls = profiles.groupBy(F.col(group).alias("cls")).agg(F.sum("n").alias("n_cls"))
    # zero cells count too: each category row is repeated for the groups, held in one array
    groups = by_cls.agg(F.collect_list(F.struct("cls", "n_cls")).alias("gs")).scalar()
    total = by_cls.agg(F.sum("n_cls")).scalar()
    full = by_cat.select("var", "cat", "n_cat", total.alias("n"), groups.alias("gs")).select(
        "var", "cat", "n_cat", "n", F.inline("gs")
    )
    t = enrich(full, cells.withColumnRenamed("n", "n_cell"), ["var", "cat", "cls"])
    n, k, j = (F.col(c).cast("double") for c in ("n", "n_cat", "n_cls"))
    x = F.coalesce("n_cell", F.lit(0)).cast("double")
    mean = k * j / n
    spread = F.sqrt(mean * (1 - k / n) * (n - j) / (n - 1))
    out = t.select(
        "var", "cat", "cls", x.cast("bigint").alias("n"), (100 * x / j).alias("pct_in_group"), (100 * k / n).alias("pct_overall"),
        F.try_divide(x - mean, spread).alias("test_value"), ((x - mean) * (x - mean) / mean).alias("__chi"),
    )
    chi = out.groupBy("var").agg(F.sum("__chi").alias("chi2"))
    return enrich(out.drop("__chi"), chi, ["var"])


def dominant_categories(described: DataFrame, top: int = 3) -> DataFrame:
    """Per group of ``describe_groups``: its most over-represented category as ``name``, and the first ``top`` as a text.

    Ties go to the smaller variable and category. Groups with no over-represented category have a null name.
    """
    over = described.filter("test_value > 0")
    label = F.concat_ws("=", "var", "cat")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.round("test_value", 9)).alias("t"), "var", "cat", label.alias("label")))), 1, top)["label"]
    named = over.groupBy("cls").agg(best.alias("best"))
    return described.select("cls").distinct().join(named.withColumnRenamed("cls", "c"), F.col("cls").eqNullSafe(F.col("c")), "left").select(
        "cls", F.get("best", F.lit(0)).alias("name"), F.concat_ws(", ", "best").alias("leading")
    )


def test_categories(profiles: DataFrame, variables: Sequence[str], group: str) -> DataFrame:
    """``describe_groups`` with exact tests.

    ``p_value`` of a (category, group) is twice the hypergeometric tail beyond its count (at most 1),
    ``test_value`` the standard normal value of that p, positive if the category is over-represented;
    both hold for counts of any size, as tails are summed in logarithms. ``chi2_p`` is the p-value of
    a variable's chi-squared statistic with ``chi2_df`` degrees of freedom.
    """
    told = describe_groups(profiles, variables, group).drop("test_value")
    sizes = profiles.groupBy(F.col(group).alias("cls")).agg(F.sum("n").alias("j"))
    cats = class_counts(profiles, variables, group).groupBy("var", "cat").agg(F.sum("n").alias("k"))
    total = profiles.agg(F.sum("n").alias("all"))
    levels = cats.groupBy("var").agg(F.count(F.lit(1)).alias("levels"))
    counted = told.join(sizes, "cls").join(cats, ["var", "cat"]).join(levels, "var")
    counted = counted.withColumns({"all": total.scalar(), "classes": sizes.agg(F.count(F.lit(1))).scalar()})
    tested = counted.withColumn("t", hypergeometric_test(F.col("n"), F.col("k"), F.col("j"), F.col("all")))
    df = ((F.col("levels") - 1) * (F.col("classes") - 1)).cast("int")
    return tested.select(
        "var", "cat", "cls", "n", "pct_in_group", "pct_overall", "t.p_value", "t.test_value", "chi2", df.alias("chi2_df"), chi2_upper(F.col("chi2"), df).alias("chi2_p")
    )


def silhouette_exact(points: DataFrame, id: str, dims: Sequence[str], cluster: str, weight: str = "n", block: int = 2_000) -> DataFrame:
    """Exact Euclidean silhouette of distinct weighted points.

    Points are dealt into blocks of about ``block``; each pair of blocks is one task that
    returns distance sums per (point, cluster), so no point pair leaves a task.
    """
    dims = list(dims)
    pts = materialise(
        points.select(F.col(id).alias("pid"), *dims, F.col(cluster).alias("cl"), F.col(weight).cast("double").alias("w"))
    )
    blocks = max(1, math.ceil(pts.count() / block))
    home = F.pmod(F.xxhash64("pid"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = pts.withColumn("bi", home).withColumn("bj", every)
    # the other side under its own names: two sides of one frame must not share columns
    there = [f"to_{d}" for d in dims]
    right = pts.select(
        every.alias("to_bi"), home.alias("to_bj"), *[F.col(d).alias(t) for d, t in zip(dims, there)],
        F.col("cl").alias("to_cl"), F.col("w").alias("to_w"),
    )

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"pid": [], "other": [], "s": []})
        # coordinate by coordinate: no array of all three dimensions
        x, y = a[dims].to_numpy(), b[there].to_numpy()
        d = np.zeros((len(x), len(y)))
        for c in range(len(dims)):
            gap = np.subtract.outer(x[:, c], y[:, c])
            d += np.square(gap, out=gap)
        np.sqrt(d, out=d)
        parts = []
        for cl, idx in b.groupby("to_cl").indices.items():
            parts.append(pd.DataFrame({"pid": a.pid.to_numpy(), "other": cl, "s": d[:, idx] @ b.to_w.to_numpy()[idx]}))
        return pd.concat(parts)

    types = {f.name: f.dataType.simpleString() for f in pts.schema.fields}
    partial = (
        left.groupBy("bi", "bj").cogroup(right.groupBy("to_bi", "to_bj"))
        .applyInPandas(sums, f"pid {types['pid']}, other {types['cl']}, s double")
        .groupBy("pid", "other").agg(F.sum("s").alias("s"))
    )
    sizes = pts.groupBy(F.col("cl").alias("other")).agg(F.sum("w").alias("size"))
    own = F.col("other") == F.col("cl")
    per_point = (
        pts.select("pid", "cl", "w").join(partial, "pid").join(sizes, "other")
        .groupBy("pid", "cl", "w").agg(
            F.max(F.when(own, F.try_divide("s", F.col("size") - 1))).alias("a"),
            F.max(F.when(own, F.col("size"))).alias("size"),
            F.min(F.when(~own, F.col("s") / F.col("size"))).alias("b"),
        )
    )
    s = F.when(F.col("size") <= 1, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per_point.select(F.col("pid").alias(id), F.col("cl").alias(cluster), F.col("w").alias(weight), s.alias("silhouette"))


def silhouette_ml(points: DataFrame, dims: Sequence[str], cluster: str, weight: str = "n") -> DataFrame:
    """Squared-Euclidean silhouette: linear cost, and a different number from the exact one."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    vec = VectorAssembler(inputCols=list(dims), outputCol="features").transform(points)
    # the evaluator reads both columns as numbers
    vec = vec.withColumn("prediction", F.col(cluster).cast("int")).withColumn("w", F.col(weight).cast("double"))
    value = ClusteringEvaluator(weightCol="w").evaluate(vec)
    return points.sparkSession.createDataFrame([(float(value),)], "silhouette_squared double")


# ---- discriminant analysis --------------------------------------------------------
#
# With T the covariance of the category indicators and D the classes' mean deviations (a column per
# class, scaled by the root of its share), both analyses follow from X = T^-1 D and M = D'X: the
# eigenvectors of M give the scores, and the pooled within covariance is T - DD', so that its inverse
# times D is X (I - M)^-1. X is found by conjugate gradients on category-pair counts that stay in
# Spark, for any number of categories; the driver holds class-by-class matrices only.


@dataclass
class ClassSolution:
    """``table``: var, cat, share and, for each class i, ``b_i`` (D) and ``x_i`` (X)."""

    variables: list[str]
    classes: list[str]
    sizes: np.ndarray
    table: DataFrame
    m: np.ndarray


def solve_classes(profiles: DataFrame, variables: Sequence[str], group: str, tol: float = 1e-11, rounds: int = 500) -> ClassSolution:
    """X and M of weighted ``profiles`` with a class column.

    A round of the conjugate gradients joins the category-pair counts with the directions and sums
    per category; each category's share is its scale. All classes' columns go through one round
    together. Residuals must fall to ``tol`` of the start within ``rounds``, or an ArithmeticError is
    raised. The classes are a result's labels and come to the driver; categories do not.
    """
    variables = list(variables)
    sized = profiles.groupBy(F.col(group).alias("cls")).agg(F.sum("n").alias("n")).orderBy("cls").collect()
    classes, sizes = [r.cls for r in sized], np.array([float(r.n) for r in sized])
    if not classes:
        raise ValueError("no complete rows to fit")
    total, of = float(sizes.sum()), range(len(sized))
    cells = materialise(burt_counts(profiles, variables))
    counts = class_counts(profiles, variables, group).groupBy("var", "cat").agg(
        F.sum("n").alias("all"), *[F.sum(F.when(F.col("cls") == c, F.col("n")).otherwise(0)).alias(f"c_{i}") for i, c in enumerate(classes)]
    )
    share = F.col("all") / total
    b = [(F.col(f"c_{i}") / float(sizes[i]) - share) * math.sqrt(sizes[i] / total) for i in of]
    now = materialise(
        counts.select(
            "var", "cat", share.alias("share"), *[b[i].alias(f"b_{i}") for i in of], *[F.lit(0.0).alias(f"x_{i}") for i in of],
            *[b[i].alias(f"r_{i}") for i in of], *[(b[i] / share).alias(f"d_{i}") for i in of],
        )
    )
    first = None
    for _ in range(rounds):
        side = now.select(F.col("var").alias("var2"), F.col("cat").alias("cat2"), *[f"d_{i}" for i in of])
        image = cells.join(side, ["var2", "cat2"]).groupBy(F.col("var1").alias("var"), F.col("cat1").alias("cat")).agg(
            *[(F.sum(F.col("n") * F.col(f"d_{i}")) / total).alias(f"y_{i}") for i in of]
        )
        now = materialise(now.join(image, ["var", "cat"]))
        sums = now.agg(
            *[
                F.sum(e)
                for i in of
                for r, d, y, s in [(F.col(f"r_{i}"), F.col(f"d_{i}"), F.col(f"y_{i}"), F.col("share"))]
                for e in (r * r / s, d * y, r * y / s, y * y / s)
            ]
        ).first()
        rr, dy, ry, yy = np.array(sums, float).reshape(len(classes), 4).T
        first = rr if first is None else first
        step = np.divide(rr, dy, out=np.zeros_like(rr), where=dy > 0)
        left = np.maximum(rr - 2 * step * ry + step * step * yy, 0.0)
        keep = np.divide(left, rr, out=np.zeros_like(rr), where=rr > 0)
        fresh = [F.col(f"r_{i}") - float(step[i]) * F.col(f"y_{i}") for i in of]
        now = now.select(
            "var", "cat", "share", *[f"b_{i}" for i in of],
            *[(F.col(f"x_{i}") + float(step[i]) * F.col(f"d_{i}")).alias(f"x_{i}") for i in of],
            *[fresh[i].alias(f"r_{i}") for i in of],
            *[(fresh[i] / F.col("share") + float(keep[i]) * F.col(f"d_{i}")).alias(f"d_{i}") for i in of],
        )
        if (left <= tol * tol * first).all():
            break
    else:
        raise ArithmeticError(f"the discriminant equations did not settle in {rounds} rounds")
    # each variable's part centred, so that scores have mean zero
    means = now.groupBy(F.col("var").alias("v")).agg(*[F.sum(F.col("share") * F.col(f"x_{i}")).alias(f"m_{i}") for i in of])
    table = materialise(
        now.join(means, F.col("var") == F.col("v")).select(
            "var", "cat", "share", *[f"b_{i}" for i in of], *[(F.col(f"x_{i}") - F.col(f"m_{i}")).alias(f"x_{i}") for i in of]
        )
    )
    m = np.array(table.agg(*[F.sum(F.col(f"b_{i}") * F.col(f"x_{j}")) for i in of for j in of]).first(), float).reshape(len(classes), -1)
    return ClassSolution(variables, classes, sizes, table, (m + m.T) / 2)


def combined(names: Sequence[str], by: Sequence[float]) -> Column:
    return reduce(add, [F.col(n) * float(c) for n, c in zip(names, by)])


def weigh(df: DataFrame, variables: Sequence[str], weights: DataFrame, of: Sequence[str]) -> DataFrame:
    """Add the sum over a row's categories of each column of ``weights`` (var, cat and ``of``).

    One left join per variable: Spark broadcasts weights that are small and splits hot categories
    of large ones. A null or unknown category makes the sums null. Columns of ``df`` must not bear
    the names ``of``.
    """
    out = df
    for i, v in enumerate(variables):
        side = weights.filter(F.col("var") == v).select(F.col("cat").alias(f"__cat{i}"), *[F.col(c).alias(f"__{c}{i}") for c in of])
        out = out.join(side, df[v] == side[f"__cat{i}"], "left")
    return out.select(*[df[c] for c in df.columns], *[reduce(add, [F.col(f"__{c}{i}") for i in range(len(variables))]).alias(c) for c in of])


def _held(weights: DataFrame, variables: Sequence[str], column: str) -> Column:
    rows = weights.select("var", "cat", column).collect()
    return weighted_sum(variables, [(r[0], r[1]) for r in rows], np.array([r[2] for r in rows]))


@dataclass
class Discriminant:
    """First discriminant score: ``weights`` has var, cat, share, ``weight`` and ``mean`` (score in the category)."""

    variables: list[str]
    classes: list[str]
    weights: DataFrame
    ratio: float

    def scored(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Rows of ``df`` with their score, by joins with the weights, which are written once so that few are broadcast."""
        weights = written(self.weights.select("var", "cat", F.col("weight").alias(name)), "discriminant-weights")
        return weigh(df, self.variables, weights, [name])

    def score(self) -> Column:
        """The score as a column expression, for variables of few categories: it holds every weight."""
        return _held(self.weights, self.variables, "weight")


def fit_discriminant(profiles: DataFrame, variables: Sequence[str], group: str, positive: str) -> Discriminant:
    """Score of unit variance that separates the classes best; ``positive`` scores above zero."""
    s = solve_classes(profiles, variables, group)
    lam, u = np.linalg.eigh(s.m)
    at, ratio = s.classes.index(positive), float(lam[-1])
    if not ratio > 1e-12:
        raise ArithmeticError("the categories do not tell the classes apart")
    by = u[:, -1] / math.sqrt(ratio)
    if (s.m @ by)[at] < 0:
        by = -by
    b, x = ([f"{k}_{i}" for i in range(len(s.classes))] for k in "bx")
    weights = s.table.select("var", "cat", "share", combined(x, by).alias("weight"), (combined(b, by) / F.col("share")).alias("mean"))
    return Discriminant(s.variables, s.classes, weights, ratio)


def discriminant_loadings(spark: SparkSession, model: Discriminant) -> DataFrame:
    """Correlation of every category indicator with the score; zero for a category that all rows have."""
    p = F.col("share")
    r = F.when(p < 1, F.col("mean") * F.sqrt(p / (1 - p))).otherwise(0.0)
    return model.weights.select(F.col("var").alias("variable"), F.col("cat").alias("category"), r.alias("correlation"))


@dataclass
class LinearClassifier:
    """``weights`` has var, cat and for each class i its ``w_i``; ``constants`` one number a class."""

    variables: list[str]
    classes: list[str]
    weights: DataFrame
    constants: np.ndarray

    def _best(self, scores: Sequence[Column]) -> Column:
        told = [F.struct((-F.round(s + float(c), 9)).alias("s"), F.lit(k).alias("cls")) for s, c, k in zip(scores, self.constants, self.classes)]
        # a null score is an unknown category: no class
        return F.when(reduce(lambda a, b: a & b, [s.isNotNull() for s in scores]), F.array_min(F.array(*told))["cls"])

    def predicted(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        """Rows of ``df`` with their most likely class, by joins with the weights; ties go to the smaller class."""
        of = [f"w_{i}" for i in range(len(self.classes))]
        # under names that no column of df bears
        own = [f"__lda_{c}" for c in of]
        summed = weigh(df, self.variables, self.weights.withColumnsRenamed(dict(zip(of, own))), own)
        return summed.select(*df.columns, self._best([F.col(c) for c in own]).alias(name))

    def column(self) -> Column:
        """The class as a column expression, for variables of few categories: it holds every weight."""
        return self._best([_held(self.weights, self.variables, f"w_{i}") for i in range(len(self.classes))])


def linear_classifier(profiles: DataFrame, variables: Sequence[str], group: str) -> LinearClassifier:
    """Class from class means and the pooled covariance of category indicators; priors are the class shares.

    Where categories part classes without exception the within covariance has no inverse along that
    direction; its ratio is then held at 1 - 1e-9, so the direction decides.
    """
    s = solve_classes(profiles, variables, group)
    total = s.sizes.sum()
    lam, u = np.linalg.eigh(s.m)
    lam = np.clip(lam, 0.0, 1 - 1e-9)
    inverse = (u / (1 - lam)) @ u.T * (total - len(s.classes)) / total
    roots = np.sqrt(s.sizes / total)
    by = inverse / roots[None, :]  # column g: what X must be multiplied by for class g
    constants = -0.5 * np.diag(s.m @ by) / roots + np.log(s.sizes / total)
    x = [f"x_{i}" for i in range(len(s.classes))]
    weights = s.table.select("var", "cat", *[combined(x, by[:, g]).alias(f"w_{g}") for g in range(len(s.classes))])
    return LinearClassifier(s.variables, s.classes, weights, constants)


def fit_linear_classifier(profiles: DataFrame, variables: Sequence[str], group: str) -> Column:
    """``linear_classifier`` as one column expression."""
    return linear_classifier(profiles, variables, group).column()
