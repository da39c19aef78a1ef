"""Rank tests, bootstrap medians, ROC and confusion tables.

Rows are reduced to counts per distinct value first; ranks come from prefix sums.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from gleanframe.functions.tails import binomial_upper, chi2_upper, exact_binomial_limit, log_binomial, normal_quantile, normal_two_sided
from gleanframe.operators.joins import enrich
from gleanframe.operators.ordering import prefix_sums, quantiles, value_counts, values_at_positions
from gleanframe.session import materialise


def rank_sums(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: size ``n``, rank sum ``r`` (ties get their mid-rank) and its part of the tie sum."""
    cells = df.dropna("any", subset=[group, value]).groupBy(value, group).agg(F.count(F.lit(1)).alias("n"))
    # a value carries at most one entry per group category
    per_value = cells.groupBy(value).agg(F.sum("n").alias("t"), F.collect_list(F.struct(group, "n")).alias("g"))
    cum = prefix_sums(per_value, [], [value], ["t"])
    mid = F.col("cum_t") - F.col("t") + (F.col("t") + 1) / 2
    rows = cum.select(mid.alias("mid"), F.col("t").cast("double").alias("t"), F.explode("g").alias("c"))
    return rows.groupBy(F.col(f"c.{group}").alias(group)).agg(
        F.sum("c.n").alias("n"),
        F.sum(F.col("mid") * F.col("c.n")).alias("r"),
        F.sum((F.col("t") * F.col("t") - 1) * F.col("c.n")).alias("ties"),
    )


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """H with tie correction, its p-value and the effect size ``(H - k + 1) / (n - k)``."""
    s = rank_sums(df, group, value).agg(
        F.sum("n").cast("double").alias("n"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("r") * F.col("r") / F.col("n")).alias("rr"), F.sum("ties").alias("ties"),
    )
    n = F.col("n")
    raw = 12 / (n * (n + 1)) * F.col("rr") - 3 * (n + 1)
    h = F.try_divide(raw, 1 - F.col("ties") / (n * n * n - n))
    out = s.select(n.cast("bigint").alias("n"), h.alias("statistic"), (F.col("k") - 1).cast("int").alias("df"))
    eta = (F.col("statistic") - F.col("df")) / (F.col("n") - F.col("df") - 1)
    return out.select("n", "statistic", "df", chi2_upper("statistic", "df").alias("p"), eta.alias("eta2"))


def dunn_pairs(df: DataFrame, group: str, value: str, blocks: int = 8) -> DataFrame:
    """Pairwise comparison of mean ranks (second minus first), Bonferroni adjusted.

    The pairs are formed among the group categories only, never among rows: the rank sums are
    dealt into ``blocks`` and every block meets every other in an equality join, so the result,
    which has a row per pair of categories, is made by as many tasks as there are pairs of blocks.
    """
    sums = materialise(rank_sums(df, group, value))
    whole = sums.agg(F.sum("n").cast("double").alias("nn"), F.sum("ties").alias("ties"), F.count(F.lit(1)).alias("k"))
    nn, ties, k = (whole.select(c).scalar() for c in ("nn", "ties", "k"))
    home, every = F.pmod(F.xxhash64(group), F.lit(blocks)), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    first = sums.select(F.col(group).alias("group1"), F.col("n").alias("n1"), F.col("r").alias("r1"), home.alias("i"), every.alias("j"))
    second = sums.select(F.col(group).alias("group2"), F.col("n").alias("n2"), F.col("r").alias("r2"), every.alias("i"), home.alias("j"))
    rows = first.join(second, ["i", "j"]).filter(F.col("group2") > F.col("group1"))
    spread = nn * (nn + 1) / 12 - ties / (12 * (nn - 1))
    z = (F.col("r2") / F.col("n2") - F.col("r1") / F.col("n1")) / F.sqrt(spread * (1 / F.col("n1") + 1 / F.col("n2")))
    out = rows.select("group1", "group2", "n1", "n2", z.alias("statistic")).withColumn("p", normal_two_sided("statistic"))
    adj = F.least(F.lit(1.0), F.col("p") * (k * (k - 1) / 2))
    return out.withColumn("p_adj", adj).withColumn("signif", stars(F.col("p_adj")))


def stars(p: Column) -> Column:
    """Conventional significance marks."""
    return F.when(p <= 1e-4, "****").when(p <= 1e-3, "***").when(p <= 0.01, "**").when(p <= 0.05, "*").otherwise("ns")


def percentile_limit(values: Column, p: float, replicates: int) -> Column:
    """Bootstrap percentile from sorted replicates, interpolated on the normal scale."""
    at = (replicates + 1) * p
    k = int(math.floor(at + 1e-9))
    low = F.element_at(values, k)
    if abs(at - k) < 1e-9:
        return low
    q = [normal_quantile(x) for x in (p, k / (replicates + 1), (k + 1) / (replicates + 1))]
    return low + (F.element_at(values, k + 1) - low) * F.lit((q[0] - q[1]) / (q[2] - q[1]))


def bootstrap_median(
    df: DataFrame, group: str, value: str, replicates: int = 2000, level: float = 0.95, seed: int = 123
) -> DataFrame:
    """Median per group with its bootstrap percentile interval.

    The median of a resample of n rows is an order statistic of n draws from the group.
    So the middle rank (two for even n) of n uniform draws is drawn from its beta law and
    looked up in the running value counts: the same distribution as resampling rows, at
    ``replicates`` lookups a group whatever the group's size. Seeded per group.
    """
    dtype = df.schema[group].dataType
    cum = materialise(prefix_sums(value_counts(df.filter(F.col(group).isNotNull()), [group], value), [group], [value], ["n"]))
    sizes = cum.groupBy(group).agg(F.max("all_n").alias("n"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        key, n = pdf[group].iloc[0], int(pdf["n"].iloc[0])
        rng = np.random.default_rng([seed, zlib.crc32(str(key).encode())])
        m = (n + 1) // 2
        u = rng.beta(m, n - m + 1, replicates)
        first = np.clip(np.ceil(n * u), 1, n)
        if n % 2:
            second = first
        else:
            v = u + (1 - u) * rng.beta(1, n - m, replicates)
            second = np.clip(np.ceil(n * v), 1, n)
        return pd.DataFrame(
            {group: key, "replicate": np.tile(np.arange(replicates), 2), "at": np.concatenate([first, second])}
        )

    schema = T.StructType(
        [T.StructField(group, dtype), T.StructField("replicate", T.IntegerType()), T.StructField("at", T.DoubleType())]
    )
    wanted = sizes.groupBy(group).applyInPandas(draw, schema)
    medians = (
        values_at_positions(cum, [group], value, wanted, "at")
        .groupBy(group, "replicate").agg(F.avg(value).alias("m"))
    )
    alpha = (1 - level) / 2
    limits = medians.groupBy(group).agg(F.array_sort(F.collect_list("m")).alias("ms")).select(
        group,
        percentile_limit(F.col("ms"), alpha, replicates).alias("ci_low"),
        percentile_limit(F.col("ms"), 1 - alpha, replicates).alias("ci_high"),
    )
    half = F.floor((F.col("all_n") + 1) / 2), F.floor((F.col("all_n") + 2) / 2)
    start = F.col("cum_n") - F.col("n")
    middle = cum.groupBy(group).agg(
        F.max("all_n").alias("n"),
        *[F.max(F.when((start < h) & (h <= F.col("cum_n")), F.col(value))).alias(f"__m{i}") for i, h in enumerate(half)],
    )
    point = middle.select(group, "n", ((F.col("__m0") + F.col("__m1")) / 2).alias("median"))
    return enrich(point, limits, [group])


#: Of the law of a bootstrap median: how many standard deviations of a rank are looked at on either side of the
#: middle, and how many rows may lie between the two middle draws. Beyond either lies less than 1e-15 in all.
REACH, BETWEEN = 8.6, 45


def bootstrap_median_law(df: DataFrame, group: str, value: str) -> DataFrame:
    """The exact law of a bootstrap median: rows (group, ``at``, ``p``), one for each value it can take.

    For an odd number n of rows it is the order statistic m = (n + 1) / 2 of n draws, which is at
    most v with the chance that a binomial of n and v's share of rows reaches m. For an even n it is
    the mean of the order statistics m = n / 2 and m + 1. These are the different values u < v just
    when m draws are at most u, one of them u, and the others are at least v, one of them v:

        C(n, m) (F(u)^m - F(u-)^m) ((1 - F(v-))^(n-m) - (1 - F(v))^(n-m))

    and are both u in what is left of the chance that the first is u. Nothing is drawn. Values
    further than ``REACH`` deviations from the middle rank and pairs with more than ``BETWEEN`` rows
    between them are left out, as their chances sum to less than 1e-15. Null values and null groups
    take no part.
    """
    cum = prefix_sums(value_counts(df.filter(F.col(group).isNotNull()), [group], value), [group], [value], ["n"])
    n, m = F.col("all_n"), F.floor((F.col("all_n") + 1) / 2)
    reach = F.lit(REACH / 2) * F.sqrt(n) + 1
    near = materialise(cum.filter((F.col("cum_n") >= n / 2 - reach) & (F.col("cum_n") - F.col("n") <= n / 2 + reach)))
    size, half = n.cast("double"), m.cast("double")
    rows = near.select(
        F.col(group), F.col(value).cast("double").alias("v"), size.alias("size"), half.alias("m"), (F.col("cum_n") - F.col("n")).alias("below"), F.col("cum_n").alias("upto"),
        (binomial_upper(half, size, F.col("cum_n") / n) - binomial_upper(half, size, (F.col("cum_n") - F.col("n")) / n)).alias("first"),
    )
    power = lambda count, times: F.when(count > 0, times * F.ln(count / F.col("size")))  # noqa: E731 (null: no such row, chance 0)
    m, rest = F.col("m"), F.col("size") - F.col("m")
    up, low = power(F.col("upto"), m), power(F.col("below"), m)
    # logs of C (F(u)^m - F(u-)^m), and of the chances that the other draws are beyond
    gap = lambda a, b: a + F.coalesce(F.log1p(-F.exp(b - a)), F.lit(0.0))
    rows = rows.withColumns({
        "left": log_binomial("size", "m") + gap(up, low), "over": power(F.col("size") - F.col("upto"), rest),
        "right": gap(power(F.col("size") - F.col("below"), rest), power(F.col("size") - F.col("upto"), rest)),
    })
    # the rows near the middle of one group, a share of it that falls with its size
    later = W.partitionBy(group).orderBy("v").rowsBetween(1, BETWEEN + 1)
    even = F.col("size") % 2 == 0
    rows = materialise(rows.withColumn("later", F.when(even, F.collect_list(F.struct("v", "below", "right")).over(later))))
    tied = F.when(even, F.col("first") - F.coalesce(F.exp(F.col("left") + F.col("over")), F.lit(0.0))).otherwise(F.col("first"))
    alone = rows.select(group, F.col("v").alias("at"), F.greatest(tied, F.lit(0.0)).alias("p"))
    pairs = rows.filter(even).select(group, "v", "upto", "left", F.explode("later").alias("to")).filter(F.col("to.below") - F.col("upto") <= BETWEEN)
    apart = pairs.select(group, ((F.col("v") + F.col("to.v")) / 2).alias("at"), F.exp(F.col("left") + F.col("to.right")).alias("p"))
    return alone.unionByName(apart).groupBy(group, "at").agg(F.sum("p").alias("p")).filter("p > 0")


def bootstrap_median_exact(df: DataFrame, group: str, value: str, level: float = 0.95) -> DataFrame:
    """Per group: n, median, mean and deviation of its bootstrap median, and the limits that hold ``level`` of its law.

    A limit is the least value that the median stays at or under with chance alpha / 2, or
    1 - alpha / 2. See ``bootstrap_median_law``; ``bootstrap_median`` draws from this law.
    """
    law = prefix_sums(bootstrap_median_law(df, group, value), [group], ["at"], ["p"])
    alpha = (1 - level) / 2
    # a hair's breadth for the rounding of sums
    limit = lambda share: F.min(F.when(F.col("cum_p") >= share * F.col("all_p") - 1e-12, F.col("at")))
    mean = F.sum(F.col("at") * F.col("p")) / F.sum("p")
    spread = F.sum(F.col("at") * F.col("at") * F.col("p")) / F.sum("p")
    told = law.groupBy(group).agg(
        mean.alias("boot_mean"), F.sqrt(F.greatest(spread - mean * mean, F.lit(0.0))).alias("boot_sd"), limit(alpha).alias("ci_low"), limit(1 - alpha).alias("ci_high")
    )
    middle = quantiles(df.filter(F.col(group).isNotNull()), [group], value, {"median": 0.5})
    return middle.join(told, group)


def score_counts(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Positives and negatives per distinct score."""
    hit = F.coalesce(positive, F.lit(False))
    return df.filter(F.col(score).isNotNull()).groupBy(score).agg(
        F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg")
    )


def roc_curve(counts: DataFrame, score: str) -> DataFrame:
    """Per distinct score: counts, rates of the rule "score >= this", and the AUC terms."""
    cum = prefix_sums(counts, [], [score], ["pos", "neg"])
    pos_below, neg_below = F.col("cum_pos") - F.col("pos"), F.col("cum_neg") - F.col("neg")
    return cum.select(
        score, "pos", "neg", "all_pos", "all_neg",
        (1 - F.try_divide(pos_below, F.col("all_pos"))).alias("sensitivity"),
        F.try_divide(neg_below, F.col("all_neg")).alias("specificity"),
        (F.col("pos") * (neg_below + F.col("neg") / 2)).alias("wins"),
    )


def roc_summary(counts: DataFrame, score: str) -> DataFrame:
    """AUC and the threshold with the largest sensitivity + specificity (lowest on ties).

    The threshold lies half way between the chosen score and the next lower one.
    """
    curve = materialise(roc_curve(counts, score))
    gain = F.round(F.col("sensitivity") + F.col("specificity"), 12)
    best = curve.agg(
        F.max_by(F.struct(score, "sensitivity", "specificity"), F.struct(gain, -F.col(score))).alias("b"),
        (F.sum("wins") / (F.max("all_pos") * F.max("all_neg"))).alias("auc"),
    )
    at = best.select(F.col(f"b.{score}")).scalar()
    below = curve.agg(F.max(F.when(F.col(score) < at, F.col(score)))).scalar()
    chosen = F.col(f"b.{score}")
    return best.select(
        "auc",
        F.coalesce((chosen + below) / 2, F.lit(float("-inf"))).alias("threshold"),
        F.col("b.sensitivity").alias("sensitivity"),
        F.col("b.specificity").alias("specificity"),
    )


def confusion(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """Counts per (predicted, actual)."""
    return df.groupBy(predicted.alias("predicted"), actual.alias("actual")).agg(F.count(F.lit(1)).alias("n"))


def accuracy_interval(table: DataFrame, level: float = 0.95) -> DataFrame:
    """Accuracy of a confusion table with its exact binomial interval."""
    total = table.agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("predicted") == F.col("actual"), F.col("n"))), F.lit(0)).alias("right")
    )
    tail = (1 - level) / 2
    return total.select(
        "n", "right", (F.col("right") / F.col("n")).alias("accuracy"),
        exact_binomial_limit("right", "n", F.lit(tail)).alias("ci_lower"),
        exact_binomial_limit("right", "n", F.lit(1 - tail)).alias("ci_upper"),
    )


def cohens_d(df: DataFrame, group: str, value: str, low: str, high: str) -> DataFrame:
    """Standardised mean difference ``high - low`` with the pooled deviation."""
    g = lambda name, agg: agg(F.when(F.col(group) == name, F.col(value)))
    n1, n2 = g(low, F.count), g(high, F.count)
    s1, s2 = g(low, F.stddev_samp), g(high, F.stddev_samp)
    pooled = F.sqrt((s1 * s1 * (n1 - 1) + s2 * s2 * (n2 - 1)) / (n1 + n2 - 2))
    return df.agg(
        (g(high, F.avg) - g(low, F.avg)).alias("mean_difference"), pooled.alias("pooled_sd"),
        F.try_divide(g(high, F.avg) - g(low, F.avg), pooled).alias("d"),
    )


def group_moments(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Centre and covariance of two coordinates per group (the basis of an ellipse)."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"),
        F.var_samp(x).alias("var_x"), F.var_samp(y).alias("var_y"), F.covar_samp(x, y).alias("cov_xy"),
    )


def robust_moments(
    df: DataFrame, by: Sequence[str], x: str, y: str, freedom: float = 5.0, rounds: int = 25, tol: float = 0.01, level: float = 0.95
) -> DataFrame:
    """Centre and covariance of two coordinates per group under a t law, the basis of a robust ellipse.

    Reweighted means: a point at squared distance q from the centre, measured in the covariance,
    weighs (1 + 2 / freedom) / (1 + q / freedom). Points are counted first, then a round is one pass
    of sums per group and the groups' next centres; ``rounds`` at most, until no weight of the group
    moves by ``tol``. ``converged`` says so, ``n_rounds`` counts, and ``radius`` scales the ellipse
    that holds ``level``. Points with a null coordinate or group take no part; groups whose points lie on a
    line have null moments and do not converge.
    """
    by = list(by)
    points = df.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna("any")
    points = materialise(points.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("n")))
    names = ["mx", "my", "xx", "yy", "xy"]

    # sums about the plain mean, so that nothing is lost to large coordinates
    centre = points.groupBy(*by).agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(f"o{c}") for c in "xy"])
    points = materialise(points.join(centre, by).select(*by, (F.col("x") - F.col("ox")).alias("x"), (F.col("y") - F.col("oy")).alias("y"), "n", "ox", "oy"))

    def distance(prefix: str) -> Column:
        mx, my, xx, yy, xy = (F.col(f"{prefix}{c}") for c in names)
        dx, dy = F.col("x") - mx, F.col("y") - my
        det = xx * yy - xy * xy
        return F.when(det > 1e-12 * xx * yy, (dx * dx * yy - 2 * dx * dy * xy + dy * dy * xx) / det)

    def weight(prefix: str) -> Column:
        return (1 + 2 / freedom) / (1 + distance(prefix) / freedom)

    def sums(w: Column, moved: Column) -> list[Column]:
        n = F.col("n") * w
        parts = {"w": n, "sx": n * F.col("x"), "sy": n * F.col("y"), "sxx": n * F.col("x") * F.col("x"), "syy": n * F.col("y") * F.col("y"), "sxy": n * F.col("x") * F.col("y")}
        return [*(F.sum(v).alias(k) for k, v in parts.items()), F.max(moved).alias("moved"), F.sum("n").alias("count"), F.first("ox").alias("ox"), F.first("oy").alias("oy")]

    def next_state(summed: DataFrame, old: list[Column]) -> DataFrame:
        mx, my = F.col("sx") / F.col("w"), F.col("sy") / F.col("w")
        share = F.col("w")
        cov = {"xx": F.col("sxx") / share - mx * mx, "yy": F.col("syy") / share - my * my, "xy": F.col("sxy") / share - mx * my}
        return summed.select(*by, "count", "ox", "oy", "moved", mx.alias("mx"), my.alias("my"), *[v.alias(k) for k, v in cov.items()], F.col("w").alias("total"), *old)

    zero = [F.lit(None).cast("double").alias(f"p{c}") for c in names]
    state = materialise(next_state(points.groupBy(*by).agg(*sums(F.lit(1.0), F.lit(1e300))), zero).withColumns({"n_rounds": F.lit(0), "converged": F.lit(False)}))
    done = None
    for k in range(1, rounds + 1):
        told = points.drop("ox", "oy").join(state.drop("moved", "total", "count"), by)
        before = F.coalesce(weight("p"), F.lit(1.0)) if k > 1 else F.lit(1.0)
        summed = told.groupBy(*by, *[F.col(c).alias(f"old_{c}") for c in names]).agg(*sums(weight(""), F.abs(weight("") - before)))
        fresh = next_state(summed, [F.col(f"old_{c}").alias(f"p{c}") for c in names])
        fresh = materialise(fresh.withColumns({"n_rounds": F.lit(k), "converged": F.coalesce(F.col("moved") < tol, F.lit(False))}))
        settled = fresh.filter("converged")
        done = settled if done is None else done.unionByName(settled)
        state = fresh.filter("NOT converged AND xx IS NOT NULL")
        if k == rounds or not state.limit(1).collect():
            break
    found = (done if done is not None else state.limit(0)).unionByName(state)
    radius = F.sqrt((F.col("count") - 1) * (F.pow(F.lit(1 - level), -2 / (F.col("count") - 1)) - 1))
    # the covariance is that of the weighted points, divided by their number
    scale = F.col("total") / F.col("count")
    out = found.select(
        *by, F.col("count").alias("n"), (F.col("mx") + F.col("ox")).alias("mean_x"), (F.col("my") + F.col("oy")).alias("mean_y"),
        *[(F.col(c) * scale).alias(a) for c, a in (("xx", "var_x"), ("yy", "var_y"), ("xy", "cov_xy"))],
        F.when(F.col("count") > 1, radius).alias("radius"), "n_rounds", "converged",
    )
    whole = points.groupBy(*by).agg(F.sum("n").alias("n"))
    lost = whole.join(out, by, "left_anti")
    nothing = [F.lit(None).cast("double").alias(c) for c in ("mean_x", "mean_y", "var_x", "var_y", "cov_xy", "radius")]
    return out.unionByName(lost.select(*by, "n", *nothing, F.lit(0).alias("n_rounds"), F.lit(False).alias("converged")))


__all__ = [
    "rank_sums", "kruskal_wallis", "dunn_pairs", "stars", "bootstrap_median", "score_counts", "roc_curve", "roc_summary",
    "confusion", "accuracy_interval", "cohens_d", "group_moments", "robust_moments", "bootstrap_median_law", "bootstrap_median_exact", "quantiles",
]
