"""Rank statistics, bootstrap, ROC and confusion over the mention view."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanframe.functions.nulls import rounded
from gleanframe.operators import ranks
from gleanframe.plans.registry import query
from gleanframe.plans.sqlviews import with_views
from gleanframe.sources.standins import mentions, table

RANKS = """
, t AS (SELECT range_pct AS v, count(*) AS t FROM mentions GROUP BY 1)
, m AS (SELECT v, t, sum(t) OVER (ORDER BY v) - t + (t + 1) / 2.0::DOUBLE AS mid FROM t)
, g AS (SELECT presence, count(*) AS n, sum(mid) AS r FROM mentions JOIN m ON v = range_pct GROUP BY 1)
, s AS (SELECT sum(n)::DOUBLE AS n, count(*) AS k, 12 / (sum(n)::DOUBLE * (sum(n) + 1)) * sum(r * r / n) - 3 * (sum(n) + 1) AS raw,
        (SELECT sum(t::DOUBLE * t * t - t) FROM t) AS ties FROM g)
"""


@query("kruskal_wallis", with_views("mentions", RANKS + """
, h AS (SELECT n, k, raw / (1 - ties / (n * n * n - n)) AS h FROM s)
SELECT n::BIGINT AS n, round(h, 6) AS statistic, (k - 1)::INTEGER AS df, round(exp(-h / 2) * (1 + h / 2), 6) AS p,
       round((h - k + 1) / (n - k), 6) AS eta2 FROM h"""))
def kruskal_wallis(spark, sf):
    # five priorities, so four degrees of freedom: the check uses that closed form
    df = ranks.kruskal_wallis(mentions(spark, sf, "presence", "range_pct"), "presence", "range_pct")
    return df.withColumns({c: rounded(c) for c in ("statistic", "p", "eta2")})


@query("dunn_pairs", with_views("mentions", RANKS + """
, z AS (SELECT a.presence AS group1, b.presence AS group2, a.n AS n1, b.n AS n2, s.k * (s.k - 1) / 2 AS m,
    (b.r / b.n - a.r / a.n) / sqrt((s.n * (s.n + 1) / 12 - ties / (12 * (s.n - 1))) * (1 / a.n::DOUBLE + 1 / b.n::DOUBLE)) AS z
  FROM g a JOIN g b ON a.presence < b.presence, s)
, p AS (SELECT *, 1 - 2 * abs(z) / 4000 / 3 / sqrt(2 * pi()) * list_sum(list_transform(range(4001),
    lambda i: (CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * pow(i * abs(z) / 4000, 2)))) AS p FROM z)
SELECT group1, group2, n1, n2, round(z, 6) AS statistic, round(p, 6) AS p, round(least(1.0, p * m), 6) AS p_adj,
       CASE WHEN p * m <= 0.0001 THEN '****' WHEN p * m <= 0.001 THEN '***' WHEN p * m <= 0.01 THEN '**' WHEN p * m <= 0.05 THEN '*' ELSE 'ns' END AS signif
FROM p"""))
def dunn_pairs(spark, sf):
    df = ranks.dunn_pairs(mentions(spark, sf, "presence", "range_pct"), "presence", "range_pct")
    return df.withColumns({c: rounded(c) for c in ("statistic", "p", "p_adj")})


@query("bootstrap_median_ci")
def bootstrap_median_ci(spark, sf):
    df = table(spark, sf, "customer").select("c_mktsegment", "c_acctbal")
    return ranks.bootstrap_median(df, "c_mktsegment", "c_acctbal")


@query("bootstrap_median_exact", """
WITH c AS (SELECT c_mktsegment AS g, c_acctbal AS v, count(*) AS n FROM customer WHERE c_acctbal IS NOT NULL GROUP BY 1, 2),
f AS (SELECT g, v, (sum(n) OVER (PARTITION BY g ORDER BY v) - n)::BIGINT AS a, (sum(n) OVER (PARTITION BY g ORDER BY v))::BIGINT AS b, (sum(n) OVER (PARTITION BY g))::BIGINT AS s, row_number() OVER (PARTITION BY g ORDER BY v) AS i FROM c),
m AS (SELECT *, (s + 1) // 2 AS m, lgamma(s + 1.0::DOUBLE) AS ls FROM f),
upto AS (
  SELECT g, i, sum(exp(ls - lgamma(k + 1.0::DOUBLE) - lgamma(s - k + 1.0::DOUBLE) + k * ln(b / s::DOUBLE) + (s - k) * ln(1 - b / s::DOUBLE))) AS p
  FROM (SELECT g, i, b, s, ls, unnest(range(m, s + 1)) AS k FROM m WHERE b < s) GROUP BY g, i
  UNION ALL SELECT g, i, 1 FROM m WHERE b = s),
one AS (SELECT m.*, p - coalesce(lag(p) OVER (PARTITION BY m.g ORDER BY m.i), 0) AS first, ls - lgamma(m.m + 1.0::DOUBLE) - lgamma(s - m.m + 1.0::DOUBLE) AS lc FROM m JOIN upto USING (g, i)),
part AS (
  SELECT *, exp(lc + s * ln(0.5::DOUBLE)) * (pow(b / (0.5::DOUBLE * s), m) - pow(a / (0.5::DOUBLE * s), m)) AS l, pow((s - a) / (0.5::DOUBLE * s), s - m) AS ra, pow((s - b) / (0.5::DOUBLE * s), s - m) AS rb FROM one),
law AS (
  SELECT g, v::DOUBLE AS t, CASE WHEN s % 2 = 1 THEN first ELSE first - l * rb END AS p FROM part
  UNION ALL SELECT x.g, (x.v + y.v) / 2.0::DOUBLE, x.l * (y.ra - y.rb) FROM part x JOIN part y ON x.g = y.g AND x.i < y.i WHERE x.s % 2 = 0),
atom AS (SELECT g, t, sum(p) AS p FROM law GROUP BY g, t),
cum AS (SELECT *, sum(p) OVER (PARTITION BY g ORDER BY t) AS q FROM atom)
SELECT c_mktsegment, n, round(median, 6) AS median, round(m1, 4) AS boot_mean, round(sqrt(m2), 4) AS boot_sd, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high
FROM (SELECT c_mktsegment, count(*) AS n, median(c_acctbal) AS median FROM customer WHERE c_acctbal IS NOT NULL GROUP BY 1)
JOIN (SELECT g, sum(t * p) AS m1, min(t) FILTER (q >= 0.025 - 1e-12) AS lo, min(t) FILTER (q >= 0.975 - 1e-12) AS hi FROM cum GROUP BY g) z ON z.g = c_mktsegment
JOIN (SELECT g, sum(p * pow(t - m1, 2)) AS m2 FROM atom JOIN (SELECT g, sum(t * p) AS m1 FROM atom GROUP BY g) USING (g) GROUP BY g) w ON w.g = c_mktsegment""")
def bootstrap_median_exact(spark, sf):
    out = ranks.bootstrap_median_exact(table(spark, sf, "customer").select("c_mktsegment", "c_acctbal"), "c_mktsegment", "c_acctbal")
    out = out.withColumns({c: F.round(c, 4) for c in ("boot_mean", "boot_sd")})
    return out.withColumns({c: rounded(c) for c in ("median", "ci_low", "ci_high")})


@query("group_median", """
SELECT c_mktsegment, count(*) AS n, round(median(c_acctbal), 6) AS median FROM customer GROUP BY 1""")
def group_median(spark, sf):
    q = ranks.quantiles(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal", {"median": 0.5})
    return q.withColumn("median", rounded("median"))


@query("roc_auc_youden", with_views("mentions", """
, c AS (SELECT range_pct AS v, count(*) FILTER (answer = 'Unsustainable') AS pos, count(*) FILTER (answer <> 'Unsustainable') AS neg FROM mentions GROUP BY 1)
, r AS (SELECT v, pos, neg, sum(pos) OVER (ORDER BY v) - pos AS pb, sum(neg) OVER (ORDER BY v) - neg AS nb,
        sum(pos) OVER ()::DOUBLE AS p, sum(neg) OVER ()::DOUBLE AS n, lag(v) OVER (ORDER BY v) AS below FROM c)
, b AS (SELECT *, 1 - pb / p AS sens, nb / n AS spec FROM r)
SELECT round((SELECT sum(pos * (nb + neg / 2.0::DOUBLE)) / any_value(p * n) FROM r), 6) AS auc,
       round(coalesce((v + below) / 2, '-infinity'::DOUBLE), 6) AS threshold, round(sens, 6) AS sensitivity, round(spec, 6) AS specificity
FROM b ORDER BY round(sens + spec, 12) DESC, v LIMIT 1"""))
def roc_auc_youden(spark, sf):
    m = mentions(spark, sf, "answer", "range_pct")
    df = ranks.roc_summary(ranks.score_counts(m, "range_pct", F.col("answer") == "Unsustainable"), "range_pct")
    return df.withColumns({c: rounded(c) for c in df.columns})


@query("confusion_matrix", with_views("mentions", """
SELECT CASE WHEN range_pct > 34 THEN 'Unsustainable' ELSE 'Sustainable' END AS predicted, answer AS actual, count(*) AS n FROM mentions GROUP BY 1, 2"""))
def confusion_matrix(spark, sf):
    m = mentions(spark, sf, "answer", "range_pct")
    predicted = F.when(F.col("range_pct") > 34, "Unsustainable").otherwise("Sustainable")
    return ranks.confusion(m, predicted, F.col("answer"))


@query("confusion_ci", """WITH RECURSIVE """ + with_views("mentions", """
, c AS (SELECT count(*) AS n, count(*) FILTER ((range_pct > 34) = (answer = 'Unsustainable')) AS x FROM mentions)
, k AS (SELECT i, lgamma(n + 1.0::DOUBLE) - lgamma(i + 1.0::DOUBLE) - lgamma(n - i + 1.0::DOUBLE) AS lc FROM (SELECT n, unnest(range(n + 1)) AS i FROM c))
, b AS (
  SELECT 0 AS step, 1e-9::DOUBLE AS lo, 1 - 1e-9::DOUBLE AS hi, 1e-9::DOUBLE AS lo2, 1 - 1e-9::DOUBLE AS hi2
  UNION ALL
  SELECT step + 1, CASE WHEN up < 0.025 THEN mid ELSE lo END, CASE WHEN up < 0.025 THEN hi ELSE mid END,
         CASE WHEN down < 0.025 THEN lo2 ELSE mid2 END, CASE WHEN down < 0.025 THEN mid2 ELSE hi2 END
  FROM (SELECT b.*, (lo + hi) / 2 AS mid, (lo2 + hi2) / 2 AS mid2,
          (SELECT sum(exp(lc + i * ln((lo + hi) / 2) + (n - i) * ln(1 - (lo + hi) / 2))) FROM k, c WHERE i >= x) AS up,
          (SELECT sum(exp(lc + i * ln((lo2 + hi2) / 2) + (n - i) * ln(1 - (lo2 + hi2) / 2))) FROM k, c WHERE i <= x) AS down
        FROM b WHERE step < 45))
SELECT n, x AS "right", round(x / n::DOUBLE, 6) AS accuracy, round(lo, 6) AS ci_lower, round(lo2, 6) AS ci_upper FROM b, c WHERE step = 45""")[5:])
def confusion_ci(spark, sf):
    df = ranks.accuracy_interval(confusion_matrix(spark, sf))
    return df.withColumns({c: rounded(c) for c in ("accuracy", "ci_lower", "ci_upper")})


@query("cohens_d", with_views("mentions", """
, s AS (SELECT avg(range_pct) FILTER (answer = 'Unsustainable') AS m2, avg(range_pct) FILTER (answer = 'Sustainable') AS m1,
    var_samp(range_pct) FILTER (answer = 'Unsustainable') AS v2, var_samp(range_pct) FILTER (answer = 'Sustainable') AS v1,
    count(*) FILTER (answer = 'Unsustainable') AS n2, count(*) FILTER (answer = 'Sustainable') AS n1 FROM mentions)
SELECT round(m2 - m1, 6) AS mean_difference, round(sqrt((v1 * (n1 - 1) + v2 * (n2 - 1)) / (n1 + n2 - 2)), 6) AS pooled_sd,
       round((m2 - m1) / sqrt((v1 * (n1 - 1) + v2 * (n2 - 1)) / (n1 + n2 - 2)), 6) AS d FROM s"""))
def cohens_d(spark, sf):
    df = ranks.cohens_d(mentions(spark, sf, "answer", "range_pct"), "answer", "range_pct", "Sustainable", "Unsustainable")
    return df.withColumns({c: rounded(c) for c in df.columns})


@query("group_moments", """
SELECT p_type, count(*) AS n, round(avg(l_quantity), 6) AS mean_x, round(avg(l_discount), 6) AS mean_y, round(var_samp(l_quantity), 6) AS var_x,
       round(var_samp(l_discount), 6) AS var_y, round(covar_samp(l_quantity, l_discount), 6) AS cov_xy
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def group_moments(spark, sf):
    df = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    out = ranks.group_moments(df, ["p_type"], "l_quantity", "l_discount")
    return out.withColumns({c: rounded(c) for c in ("mean_x", "mean_y", "var_x", "var_y", "cov_xy")})


@query("robust_moments", """
WITH RECURSIVE p AS (
  SELECT p_type AS g, l_quantity::DOUBLE - avg(l_quantity) OVER (PARTITION BY p_type) AS x, l_extendedprice::DOUBLE - avg(l_extendedprice) OVER (PARTITION BY p_type) AS y,
         avg(l_quantity) OVER (PARTITION BY p_type) AS ox, avg(l_extendedprice) OVER (PARTITION BY p_type) AS oy
  FROM lineitem JOIN part ON l_partkey = p_partkey),
f AS (
  SELECT g, 0 AS k, 0.0::DOUBLE AS mx, 0.0::DOUBLE AS my, avg(x * x) AS xx, avg(y * y) AS yy, avg(x * y) AS xy, NULL::DOUBLE AS pmx, NULL::DOUBLE AS pmy, NULL::DOUBLE AS pxx, NULL::DOUBLE AS pyy, NULL::DOUBLE AS pxy,
         1e300::DOUBLE AS moved, count(*)::DOUBLE AS w, count(*)::DOUBLE AS c FROM p GROUP BY g
  UNION ALL
  SELECT g, k + 1, sum(w * x) / sum(w), sum(w * y) / sum(w), sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2), sum(w * y * y) / sum(w) - pow(sum(w * y) / sum(w), 2),
         sum(w * x * y) / sum(w) - sum(w * x) / sum(w) * sum(w * y) / sum(w), mx, my, xx, yy, xy, max(abs(w - before)), sum(w), any_value(c)
  FROM (
    SELECT f.g, k, x, y, mx, my, xx, yy, xy, c, 1.4 / (1 + (pow(x - mx, 2) * yy - 2 * (x - mx) * (y - my) * xy + pow(y - my, 2) * xx) / (xx * yy - xy * xy) / 5) AS w,
           coalesce(1.4 / (1 + (pow(x - pmx, 2) * pyy - 2 * (x - pmx) * (y - pmy) * pxy + pow(y - pmy, 2) * pxx) / (pxx * pyy - pxy * pxy) / 5), 1) AS before
    FROM f JOIN p ON p.g = f.g WHERE moved >= 0.01 AND k < 25)
  GROUP BY g, k, mx, my, xx, yy, xy),
last AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY g ORDER BY k DESC) = 1)
SELECT last.g AS p_type, c::BIGINT AS n, round(mx + ox, 6) AS mean_x, round(my + oy, 4) AS mean_y, round(xx * w / c, 4) AS var_x, round(yy * w / c, 0) AS var_y, round(xy * w / c, 2) AS cov_xy,
       round(sqrt((c - 1) * (pow(0.05, -2 / (c - 1)) - 1)), 6) AS radius, k AS n_rounds, moved < 0.01 AS converged
FROM last JOIN (SELECT g, any_value(ox) AS ox, any_value(oy) AS oy FROM p GROUP BY g) o ON o.g = last.g""")
def robust_moments(spark, sf):
    df = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    out = ranks.robust_moments(df, ["p_type"], "l_quantity", "l_extendedprice")
    digits = {"mean_x": 6, "mean_y": 4, "var_x": 4, "var_y": 0, "cov_xy": 2, "radius": 6}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})
