"""Factor, cluster, discriminant and regression analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanframe.functions.nulls import rounded
from gleanframe.operators import factor as X, joins, mentions as M, ordering, ranks, regress as G
from gleanframe.plans.mention_queries import CURVE, curve
from gleanframe.plans.registry import query
from gleanframe.plans.sqlviews import with_views
from gleanframe.session import dealt, materialise, written
from gleanframe.sources.standins import PROFILE_VARIABLES, SEGMENTS, mentions, n_mentions, profile, table

VARS = list(PROFILE_VARIABLES)


@query("mca_burt", with_views("profile", """
, l AS (UNPIVOT profile ON segment, region, balance_band, order_band INTO NAME var VALUE cat)
SELECT a.var AS var1, a.cat AS cat1, b.var AS var2, b.cat AS cat2, count(*) AS n FROM l a JOIN l b USING (id) GROUP BY ALL"""))
def mca_burt(spark, sf):
    return X.burt_counts(X.profile_counts(profile(spark, sf), VARS), VARS)


def _mca(spark, sf):
    profiles = materialise(X.profile_counts(profile(spark, sf), VARS))
    return profiles, X.fit_mca(profiles, VARS)


@query("mca_eigen")
def mca_eigen(spark, sf):
    return X.mca_eigen(spark, _mca(spark, sf)[1])


@query("mca_category_coords")
def mca_category_coords(spark, sf):
    return X.mca_categories(spark, _mca(spark, sf)[1])


@query("mca_top_categories")
def mca_top_categories(spark, sf):
    cats = X.mca_categories(spark, _mca(spark, sf)[1], axes=2)
    best = [
        ordering.top_exact(cats.filter(F.col("axis") == a), [F.desc("contrib"), "variable", "category"], 10).select("variable", "category")
        for a in (1, 2)
    ]
    return joins.keep_members(cats, best[0].unionByName(best[1]).distinct(), ["variable", "category"])


@query("mca_row_scores")
def mca_row_scores(spark, sf):
    rows = profile(spark, sf).dropna("any")
    return X.mca_scores(rows, X.fit_mca(X.profile_counts(rows, VARS), VARS)).select("id", *[f"dim_{i}" for i in range(1, 6)])


def _clusters(spark, sf):
    profiles, model = _mca(spark, sf)
    points = X.mca_scores(profiles, model)
    dims = [f"dim_{i}" for i in range(1, 6)]
    return model, X.fit_clusters(points, dims), dims


def clustered_profiles(spark, sf):
    """Respondents with their cluster, and the model the clusters live in."""
    model, clusters, _ = _clusters(spark, sf)
    return profile(spark, sf).dropna("any").withColumn("cluster", clusters.label(model)), model


@query("cluster_profiles")
def cluster_profiles(spark, sf):
    return clustered_profiles(spark, sf)[0].select("id", "cluster")


@query("cluster_describe")
def cluster_describe(spark, sf):
    rows, _ = clustered_profiles(spark, sf)
    counts = materialise(X.profile_counts(rows, VARS, "cluster"))
    return X.describe_groups(counts, VARS, "cluster")


GROUP_TESTS = """
, l AS (SELECT id, var, cat FROM (UNPIVOT profile ON region, balance_band, order_band INTO NAME var VALUE cat))
, s AS (SELECT id, segment FROM profile)
, c AS (SELECT var, cat, count(*)::DOUBLE AS k FROM l GROUP BY ALL), g AS (SELECT segment AS cls, count(*)::DOUBLE AS j FROM s GROUP BY 1)
, x AS (SELECT var, cat, segment AS cls, count(*) AS x FROM l JOIN s USING (id) GROUP BY ALL)
, t AS (SELECT c.var, c.cat, g.cls, coalesce(x, 0)::BIGINT AS n, k, j, (SELECT count(*)::DOUBLE FROM s) AS nn, coalesce(x, 0) - k * j / (SELECT count(*) FROM s) AS diff
  FROM c CROSS JOIN g LEFT JOIN x USING (var, cat, cls))"""


@query("group_describe", with_views("profile", GROUP_TESTS + """
SELECT var, cat, cls, n, round(100 * n / j, 6) AS pct_in_group, round(100 * k / nn, 6) AS pct_overall,
       round(diff / sqrt(k * j / nn * (1 - k / nn) * (nn - j) / (nn - 1)), 6) AS test_value,
       round(sum(diff * diff / (k * j / nn)) OVER (PARTITION BY var), 6) AS chi2 FROM t"""))
def group_describe(spark, sf):
    counts = materialise(X.profile_counts(profile(spark, sf), VARS))
    df = X.describe_groups(counts, VARS[1:], "segment")
    return df.withColumns({c: rounded(c) for c in ("pct_in_group", "pct_overall", "test_value", "chi2")})


@query("group_dominant_categories", with_views("profile", GROUP_TESTS + """
, v AS (SELECT cls, var || '=' || cat AS label, round(diff / sqrt(k * j / nn * (1 - k / nn) * (nn - j) / (nn - 1)), 9) AS t, var, cat FROM t)
, r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY t DESC, var, cat) AS i FROM v WHERE t > 0)
SELECT cls, max(label) FILTER (i = 1) AS name, string_agg(label, ', ' ORDER BY i) FILTER (i <= 3) AS leading FROM r GROUP BY cls"""))
def group_dominant_categories(spark, sf):
    counts = materialise(X.profile_counts(profile(spark, sf), VARS))
    return X.dominant_categories(X.describe_groups(counts, VARS[1:], "segment"))


@query("cluster_names")
def cluster_names(spark, sf):
    """Clusters by their dominant categories, with their sizes and whether the fit settled."""
    profiles, model = _mca(spark, sf)
    fit = X.fit_clusters(X.mca_scores(profiles, model), [f"dim_{i}" for i in range(1, 6)])
    labelled = materialise(profiles.withColumn("cluster", fit.label(model)))
    names = X.dominant_categories(X.describe_groups(labelled, VARS, "cluster")).withColumnRenamed("cls", "cluster")
    sizes = labelled.groupBy("cluster").agg(F.sum("n").alias("n"))
    return joins.enrich(sizes, names, ["cluster"]).withColumn("converged", F.lit(fit.converged))


@query("category_test_values", with_views("profile", """
, l AS (SELECT id, var, cat FROM (UNPIVOT profile ON region, balance_band, order_band INTO NAME var VALUE cat))
, s AS (SELECT id, segment FROM profile)
, c AS (SELECT var, cat, count(*) AS k FROM l GROUP BY ALL), g AS (SELECT segment AS cls, count(*) AS j FROM s GROUP BY 1)
, x AS (SELECT var, cat, segment AS cls, count(*) AS x FROM l JOIN s USING (id) GROUP BY ALL)
, t AS (SELECT c.var, c.cat, g.cls, coalesce(x, 0)::BIGINT AS n, k, j, (SELECT count(*) FROM s) AS nn FROM c CROSS JOIN g LEFT JOIN x USING (var, cat, cls))
, tail AS (
  SELECT var, cat, cls, sum(exp(lgamma(k + 1.0::DOUBLE) - lgamma(i + 1.0::DOUBLE) - lgamma(k - i + 1.0::DOUBLE)
      + lgamma(nn - k + 1.0::DOUBLE) - lgamma(j - i + 1.0::DOUBLE) - lgamma(nn - k - j + i + 1.0::DOUBLE)
      - lgamma(nn + 1.0::DOUBLE) + lgamma(j + 1.0::DOUBLE) + lgamma(nn - j + 1.0::DOUBLE))) AS p
  FROM (SELECT *, unnest(CASE WHEN n * nn > k * j THEN range(n, least(k, j) + 1) ELSE range(greatest(0, k + j - nn), n + 1) END) AS i FROM t) GROUP BY ALL)
, h AS (SELECT var, sum(pow(n - k * j / nn::DOUBLE, 2) / (k * j / nn::DOUBLE)) AS h, ((count(DISTINCT cat) - 1) * (count(DISTINCT cls) - 1))::INTEGER AS df FROM t GROUP BY var)
SELECT var, cat, cls, n, round(100.0::DOUBLE * n / j, 6) AS pct_in_group, round(100.0::DOUBLE * k / nn, 6) AS pct_overall, round(least(1.0, 2 * p), 6) AS p_value,
       round(h, 6) AS chi2, df AS chi2_df, round(exp(-h / 2) * list_sum(list_transform(range(df // 2), lambda i: pow(h / 2, i) / gamma(i + 1.0::DOUBLE))), 6) AS chi2_p
FROM t JOIN tail USING (var, cat, cls) JOIN h USING (var)"""))
def category_test_values(spark, sf):
    # five segments, so an even number of degrees of freedom: the check uses that closed form; tests hold test_value
    counts = materialise(X.profile_counts(profile(spark, sf), VARS))
    df = X.test_categories(counts, VARS[1:], "segment").drop("test_value")
    return df.withColumns({c: rounded(c) for c in ("pct_in_group", "pct_overall", "p_value", "chi2", "chi2_p")})


def _points(spark, sf):
    profiles, model = _mca(spark, sf)
    dims = [f"dim_{i}" for i in range(1, 6)]
    points = X.mca_scores(profiles, model)
    clusters = X.fit_clusters(points, dims)
    key = F.concat_ws("|", *VARS)
    return points.withColumn("cluster", clusters.label(model)).withColumn("point", key), dims


@query("silhouette_exact")
def silhouette_exact(spark, sf):
    points, dims = _points(spark, sf)
    s = X.silhouette_exact(points, "point", dims, "cluster")
    return s.groupBy("cluster").agg(
        F.sum("n").alias("n"), (F.sum(F.col("silhouette") * F.col("n")) / F.sum("n")).alias("silhouette")
    )


@query("silhouette_ml")
def silhouette_ml(spark, sf):
    points, dims = _points(spark, sf)
    return X.silhouette_ml(points, dims, "cluster")


@query("cluster_moments")
def cluster_moments(spark, sf):
    rows, model = clustered_profiles(spark, sf)
    return ranks.group_moments(X.mca_scores(rows, model, axes=2), ["cluster"], "dim_1", "dim_2")


@query("cluster_composition")
def cluster_composition(spark, sf):
    return M.contingency_percent(clustered_profiles(spark, sf)[0], "cluster", "segment", SEGMENTS).drop("undeclared")


def model_rows(spark, sf):
    """Distinct mention tuples with a 0/1 outcome and the respondent's profile."""
    m = mentions(spark, sf, "id", "name", "answer", "presence", "life_form", "status", "range_pct")
    # dealt by respondent: the distinct rows and the join on respondents share one shuffle
    n = n_mentions(spark, sf)
    rows = joins.enrich(dealt(m, n, "id").distinct(), dealt(profile(spark, sf), n, "id"), ["id"], how="inner")
    return rows.withColumn("y", (F.col("answer") == "Unsustainable").cast("int"))


ROWS = """
, rows AS (
  SELECT m.*, segment, region, balance_band, order_band, CASE WHEN answer = 'Unsustainable' THEN 1 ELSE 0 END AS y
  FROM (SELECT DISTINCT id, name, answer, presence, life_form, status, range_pct FROM mentions) m JOIN profile USING (id))
"""


@query("odds_ratios", with_views("mentions profile", ROWS + """
, c AS (SELECT segment, sum(y)::DOUBLE AS s, count(*) - sum(y)::DOUBLE AS f FROM rows GROUP BY 1)
, b AS (SELECT * FROM c WHERE segment = 'AUTOMOBILE')
, e AS (SELECT '(Intercept)' AS term, ln(s / f) AS est, sqrt(1 / s + 1 / f) AS se FROM b
  UNION ALL SELECT 'segment=' || c.segment, ln(c.s / c.f) - ln(b.s / b.f), sqrt(1 / c.s + 1 / c.f + 1 / b.s + 1 / b.f) FROM c, b WHERE c.segment <> 'AUTOMOBILE')
SELECT term, round(est, 6) AS estimate, round(se, 6) AS std_error, round(est / se, 6) AS z, round(exp(est), 6) AS odds_ratio,
       round(exp(est - 1.96 * se), 6) AS ci_low, round(exp(est + 1.96 * se), 6) AS ci_high FROM e"""))
def odds_ratios(spark, sf):
    # with a single categorical predictor the fit has a closed form, which the check uses
    rows = model_rows(spark, sf)
    model, terms, _ = G.logit_model(rows, "y", {"segment": "AUTOMOBILE"})
    out = G.odds_ratios(G.coefficient_table(rows, model, terms)).drop("p")
    return out.withColumns({c: rounded(c) for c in out.columns if c != "term"})


@query("logit_many_levels", with_views("mentions profile", ROWS + """
, c AS (SELECT name, sum(y)::DOUBLE AS s, count(*) - sum(y)::DOUBLE AS f FROM rows GROUP BY 1)
, b AS (SELECT * FROM c WHERE s > 0 AND f > 0 ORDER BY name LIMIT 1)
SELECT CASE WHEN c.name = b.name THEN '(Intercept)' ELSE 'name' END AS term, c.name AS level, (c.s + c.f)::BIGINT AS n, c.s = 0 OR c.f = 0 AS separated,
       round(CASE WHEN c.s = 0 OR c.f = 0 THEN NULL WHEN c.name = b.name THEN ln(c.s / c.f) ELSE ln(c.s / c.f) - ln(b.s / b.f) END, 6) AS estimate,
       round(CASE WHEN c.s = 0 OR c.f = 0 THEN NULL WHEN c.name = b.name THEN sqrt(1 / c.s + 1 / c.f) ELSE sqrt(1 / c.s + 1 / c.f + 1 / b.s + 1 / b.f) END, 6) AS std_error
FROM c, b"""))
def logit_many_levels(spark, sf):
    out = G.wide_logit(model_rows(spark, sf), "y", "name")
    return out.withColumns({c: rounded(c) for c in ("estimate", "std_error")})


@query("logit_levels_and_profile")
def logit_levels_and_profile(spark, sf):
    return G.wide_logit(model_rows(spark, sf), "y", "name", {"segment": "AUTOMOBILE", "region": None})


@query("logit_predicted_class", with_views("mentions profile", ROWS + """
, r AS (SELECT segment, avg(y) AS p FROM rows GROUP BY 1)
SELECT CASE WHEN p >= (SELECT avg(y) FROM rows) THEN 1 ELSE 0 END AS predicted, y AS actual, count(*) AS n FROM rows JOIN r USING (segment) GROUP BY ALL"""))
def logit_predicted_class(spark, sf):
    """Class from a fitted model: likelier than the share of all rows."""
    _, _, scored = G.logit_model(model_rows(spark, sf), "y", {"segment": "AUTOMOBILE"})
    share = scored.agg(F.sum("s") / F.sum("n")).first()[0]
    return G.predicted_classes(scored, float(share))


@query("cluster_as_predictor")
def cluster_as_predictor(spark, sf):
    """The respondent's cluster as predictor of the answer."""
    clusters = dealt(clustered_profiles(spark, sf)[0].select("id", "cluster"), n_mentions(spark, sf), "id")
    return G.wide_logit(joins.enrich(model_rows(spark, sf), clusters, ["id"], how="inner"), "y", "cluster")


@query("glm_logit")
def glm_logit(spark, sf):
    rows = model_rows(spark, sf)
    model, terms, _ = G.logit_model(rows, "y", {"life_form": None}, ["range_pct"])
    return G.odds_ratios(G.coefficient_table(rows, model, terms))


@query("glm_fit_quality")
def glm_fit_quality(spark, sf):
    rows = model_rows(spark, sf)
    model, terms, scored = G.logit_model(rows, "y", {"life_form": None}, ["range_pct"])
    return G.fit_quality(scored, len(terms) + 1)


@query("glm_roc")
def glm_roc(spark, sf):
    rows = model_rows(spark, sf)
    _, _, scored = G.logit_model(rows, "y", {"life_form": None}, ["range_pct"])
    counts = scored.groupBy("prediction").agg(F.sum("s").alias("pos"), F.sum(F.col("n") - F.col("s")).alias("neg"))
    return ranks.roc_summary(counts, "prediction")


@query("glmm_random_intercept")
def glmm_random_intercept(spark, sf):
    return G.odds_ratios(G.random_intercept_logit(model_rows(spark, sf), "y", "segment", "name", "AUTOMOBILE"))


@query("mor_per_species")
def mor_per_species(spark, sf):
    return G.median_odds_ratios(M.mentions_by_area(mentions(spark, sf, "id", "name", "answer", "area")))


DFA_VARS = ["presence", "life_form", "status", "segment", "region"]


def _dfa_model(rows):
    profiles = materialise(X.profile_counts(rows, DFA_VARS, "answer"))
    return X.fit_discriminant(profiles, DFA_VARS, "answer", "Unsustainable")


def _dfa(spark, sf):
    rows = model_rows(spark, sf)
    return rows, _dfa_model(rows)


@query("dfa_scores")
def dfa_scores(spark, sf):
    """Every mention that takes part in the fit, with its score."""
    rows = model_rows(spark, sf).select("id", "name", "answer", *DFA_VARS, "range_pct").dropna(subset=[*DFA_VARS, "answer"])
    # read twice, to fit and to score
    rows = written(rows, "discriminant-rows")
    return _dfa_model(rows).scored(rows)


@query("dfa_cohens_d")
def dfa_cohens_d(spark, sf):
    rows, model = _dfa(spark, sf)
    return ranks.cohens_d(model.scored(rows).select("answer", "score"), "answer", "score", "Sustainable", "Unsustainable")


@query("dfa_loadings")
def dfa_loadings(spark, sf):
    side = F.when(F.col("correlation") > 0, "Unsustainable").otherwise("Sustainable")
    loadings = X.discriminant_loadings(spark, _dfa(spark, sf)[1]).withColumn("side", side)
    return ordering.top_with_ties(loadings, F.abs("correlation"), 20).orderBy(F.desc("correlation"), "variable", "category")


@query("lda_confusion")
def lda_confusion(spark, sf):
    profiles = materialise(X.profile_counts(model_rows(spark, sf), DFA_VARS, "answer"))
    told = X.linear_classifier(profiles, DFA_VARS, "answer").predicted(profiles)
    return told.groupBy("predicted", F.col("answer").alias("actual")).agg(F.sum("n").alias("n"))


@query("saturating_fit", "WITH RECURSIVE " + with_views("mentions citations", CURVE + """
, pts AS (SELECT list(rank::DOUBLE ORDER BY rank) AS xs, list(cum_percent ORDER BY rank) AS ys FROM curve)
, it AS (
  SELECT 0 AS step, 100.0::DOUBLE AS a, 0.05::DOUBLE AS b
  UNION ALL
  SELECT step + 1, a + (sbb * sar - sab * sbr) / (saa * sbb - sab * sab), b + (saa * sbr - sab * sar) / (saa * sbb - sab * sab)
  FROM (SELECT step, a, b,
    list_sum(list_transform(xs, lambda x: pow(1 - exp(-b * x), 2))) AS saa,
    list_sum(list_transform(xs, lambda x: (1 - exp(-b * x)) * a * x * exp(-b * x))) AS sab,
    list_sum(list_transform(xs, lambda x: pow(a * x * exp(-b * x), 2))) AS sbb,
    list_sum(list_transform(range(1, len(xs) + 1), lambda i: (1 - exp(-b * xs[i])) * (ys[i] - a * (1 - exp(-b * xs[i]))))) AS sar,
    list_sum(list_transform(range(1, len(xs) + 1), lambda i: a * xs[i] * exp(-b * xs[i]) * (ys[i] - a * (1 - exp(-b * xs[i]))))) AS sbr
    FROM it, pts WHERE step < 60))
SELECT name, rank, round(a * (1 - exp(-b * rank)), 4) AS fitted FROM it, curve WHERE step = 60""")[5:])
def saturating_fit(spark, sf):
    points = curve(spark, sf)
    a, b = G.saturating_fit(points, "rank", "cum_percent")
    return points.select("name", "rank", rounded(G.saturating_prediction(F.col("rank"), a, b), 4).alias("fitted"))


# ---- the same operators on cases with a closed form ----------------------------------

BINARY = """
, z AS (SELECT CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size, CASE WHEN l_extendedprice > 40000 THEN 'dear' ELSE 'cheap' END AS price FROM lineitem)
, s AS (SELECT count(*)::DOUBLE AS n, avg(CASE WHEN size = 'big' THEN 1.0::DOUBLE ELSE 0 END) AS p, avg(CASE WHEN price = 'dear' THEN 1.0::DOUBLE ELSE 0 END) AS q,
        avg(CASE WHEN size = 'big' AND price = 'dear' THEN 1.0::DOUBLE ELSE 0 END) AS pq FROM z)
, phi AS (SELECT *, (pq - p * q) / sqrt(p * (1 - p) * q * (1 - q)) AS phi FROM s)
, axes AS (SELECT 1 AS axis, (1 + abs(phi)) / 2 AS lam, sign(phi) AS turn, p, q FROM phi UNION ALL SELECT 2, (1 - abs(phi)) / 2, -sign(phi), p, q FROM phi)
, raw AS (
  SELECT axis, lam, 'size' AS variable, 'big' AS category, p / 2 AS mass, sqrt((1 - p) / p) AS x FROM axes UNION ALL
  SELECT axis, lam, 'size', 'small', (1 - p) / 2, -sqrt(p / (1 - p)) FROM axes UNION ALL
  SELECT axis, lam, 'price', 'dear', q / 2, turn * sqrt((1 - q) / q) FROM axes UNION ALL
  SELECT axis, lam, 'price', 'cheap', (1 - q) / 2, -turn * sqrt(q / (1 - q)) FROM axes)
, flip AS (SELECT axis, sign(arg_max(x, sqrt(mass) * abs(x))) AS f FROM raw GROUP BY axis)
, std AS (SELECT axis, lam, variable, category, mass, x * f AS x FROM raw JOIN flip USING (axis))
"""


def binary_profiles(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.when(F.col("l_quantity") > 25, "big").otherwise("small").alias("size"),
        F.when(F.col("l_extendedprice") > 40000, "dear").otherwise("cheap").alias("price"),
    )
    return materialise(X.profile_counts(rows, ["size", "price"]))


@query("mca_two_binary_eigen", "WITH one AS (SELECT 1)" + BINARY + """
SELECT axis, round(lam, 6) AS eigenvalue, round(100 * lam, 6) AS percent, round(sum(100 * lam) OVER (ORDER BY axis), 6) AS cum_percent FROM axes""")
def mca_two_binary_eigen(spark, sf):
    df = X.mca_eigen(spark, X.fit_mca(binary_profiles(spark, sf), ["size", "price"]))
    return df.withColumns({c: rounded(c) for c in ("eigenvalue", "percent", "cum_percent")})


@query("mca_two_binary_coords", "WITH one AS (SELECT 1)" + BINARY + """
SELECT variable, category, axis, round(x * sqrt(lam), 6) AS coord, round(100 * mass * x * x, 6) AS contrib FROM std""")
def mca_two_binary_coords(spark, sf):
    df = X.mca_categories(spark, X.fit_mca(binary_profiles(spark, sf), ["size", "price"]))
    return df.withColumns({c: rounded(c) for c in ("coord", "contrib")})


@query("mca_two_binary_scores", "WITH one AS (SELECT 1)" + BINARY + """
SELECT size, price, count(*) AS n, round(any_value((a1.x + b1.x) / 2), 6) AS dim_1, round(any_value((a2.x + b2.x) / 2), 6) AS dim_2
FROM z JOIN std a1 ON a1.category = size AND a1.axis = 1 JOIN std b1 ON b1.category = price AND b1.axis = 1
JOIN std a2 ON a2.category = size AND a2.axis = 2 JOIN std b2 ON b2.category = price AND b2.axis = 2 GROUP BY size, price""")
def mca_two_binary_scores(spark, sf):
    profiles = binary_profiles(spark, sf)
    df = X.mca_scores(profiles, X.fit_mca(profiles, ["size", "price"]))
    return df.withColumns({c: rounded(c) for c in ("dim_1", "dim_2")})


ONE_VARIABLE = """
, k AS (SELECT presence, count(*)::DOUBLE AS n, avg(y) AS rate FROM rows GROUP BY 1)
, t AS (SELECT sum(n) AS n, sum(n * rate) / sum(n) AS mean FROM k)
, d AS (SELECT sqrt(sum(k.n * pow(rate - mean, 2)) / any_value(t.n)) AS sd FROM k, t)
"""


def one_variable(spark, sf):
    profiles = materialise(X.profile_counts(model_rows(spark, sf), ["presence"], "answer"))
    return profiles, X.fit_discriminant(profiles, ["presence"], "answer", "Unsustainable")


@query("dfa_one_variable_scores", with_views("mentions profile", ROWS + ONE_VARIABLE + """
SELECT presence, k.n::BIGINT AS n, round((rate - mean) / sd, 6) AS score FROM k, t, d"""))
def dfa_one_variable_scores(spark, sf):
    profiles, model = one_variable(spark, sf)
    return model.scored(profiles.groupBy("presence").agg(F.sum("n").alias("n"))).withColumn("score", rounded("score"))


@query("dfa_respondent_scores", with_views("mentions profile", ROWS + ONE_VARIABLE + """
SELECT id, count(*) AS n_mentions, round(avg((rate - mean) / sd), 6) AS score FROM rows JOIN k USING (presence), t, d GROUP BY id"""))
def dfa_respondent_scores(spark, sf):
    """Every mention scored, one mean score per respondent."""
    scored = one_variable(spark, sf)[1].scored(model_rows(spark, sf))
    return scored.groupBy("id").agg(F.count(F.lit(1)).alias("n_mentions"), rounded(F.avg("score")).alias("score"))


@query("lda_one_variable", with_views("mentions profile", ROWS + ONE_VARIABLE + """
, c AS (SELECT presence, k.n, rate, mean, t.n AS total, (rate - mean) / (mean * (1 - mean)) AS x FROM k, t)
, m AS (SELECT any_value(mean) AS p1, any_value(total) AS total,
    any_value(mean * (1 - mean)) * sum(x * n / total * x) AS lam,
    sum(x * n * rate) / any_value(mean * total) AS mid1, sum(x * n * (1 - rate)) / any_value((1 - mean) * total) AS mid0 FROM c)
SELECT presence, n::BIGINT AS n,
       CASE WHEN (total - 2) / total / (1 - lam) * (x - (mid1 + mid0) / 2) + ln(p1 / (1 - p1)) > 0 THEN 'Unsustainable' ELSE 'Sustainable' END AS predicted,
       round((total - 2) / total / (1 - lam) * (x - (mid1 + mid0) / 2) + ln(p1 / (1 - p1)), 6) AS log_odds
FROM (SELECT presence, n, x FROM c), m"""))
def lda_one_variable(spark, sf):
    """Class and log odds of each category from a linear classifier, its classes being two."""
    profiles = materialise(X.profile_counts(model_rows(spark, sf), ["presence"], "answer"))
    model = X.linear_classifier(profiles, ["presence"], "answer")
    told = X.weigh(model.predicted(profiles.groupBy("presence").agg(F.sum("n").alias("n"))), ["presence"], model.weights, ["w_0", "w_1"])
    at = model.classes.index("Unsustainable")
    odds = F.col(f"w_{at}") - F.col(f"w_{1 - at}") + float(model.constants[at] - model.constants[1 - at])
    return told.select("presence", "n", "predicted", rounded(odds).alias("log_odds"))


@query("dfa_one_variable_loadings", with_views("mentions profile", ROWS + ONE_VARIABLE + """
SELECT 'presence' AS variable, presence AS category, round((rate - mean) / sd * sqrt(k.n / t.n / (1 - k.n / t.n)), 6) AS correlation FROM k, t, d"""))
def dfa_one_variable_loadings(spark, sf):
    df = X.discriminant_loadings(spark, one_variable(spark, sf)[1])
    return df.withColumn("correlation", rounded("correlation"))


@query("glm_logit_numeric", "WITH RECURSIVE " + with_views("mentions profile", ROWS + """
, c AS (SELECT range_pct AS v, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS s FROM rows GROUP BY 1)
, l AS (SELECT list(v ORDER BY v) AS v, list(n ORDER BY v) AS n, list(s ORDER BY v) AS s FROM c)
, it AS (
  SELECT 0 AS step, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS h00, 0.0::DOUBLE AS h01, 1.0::DOUBLE AS h11
  UNION ALL
  SELECT step + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01), h00, h01, h11
  FROM (SELECT step, a, b,
    list_sum(list_transform(range(1, len(v) + 1), lambda i: s[i] - n[i] / (1 + exp(-a - b * v[i])))) AS g0,
    list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * (s[i] - n[i] / (1 + exp(-a - b * v[i]))))) AS g1,
    list_sum(list_transform(range(1, len(v) + 1), lambda i: n[i] / (1 + exp(-a - b * v[i])) / (1 + exp(a + b * v[i])))) AS h00,
    list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * n[i] / (1 + exp(-a - b * v[i])) / (1 + exp(a + b * v[i])))) AS h01,
    list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * v[i] * n[i] / (1 + exp(-a - b * v[i])) / (1 + exp(a + b * v[i])))) AS h11
    FROM (SELECT step, a, b FROM it WHERE step < 20), l))
SELECT term, round(est, 6) AS estimate, round(se, 6) AS std_error, round(exp(est), 6) AS odds_ratio
FROM (SELECT '(Intercept)' AS term, a AS est, sqrt(h11 / (h00 * h11 - h01 * h01)) AS se FROM it WHERE step = 20
      UNION ALL SELECT 'range_pct', b, sqrt(h00 / (h00 * h11 - h01 * h01)) FROM it WHERE step = 20)""")[5:])
def glm_logit_numeric(spark, sf):
    rows = model_rows(spark, sf)
    model, terms, _ = G.logit_model(rows, "y", {}, ["range_pct"])
    out = G.odds_ratios(G.coefficient_table(rows, model, terms)).select("term", "estimate", "std_error", "odds_ratio")
    return out.withColumns({c: rounded(c) for c in ("estimate", "std_error", "odds_ratio")})


BANDS = """
WITH pts AS (SELECT concat(l_quantity::BIGINT, '/', round(l_discount * 100)::BIGINT) AS pt, l_quantity AS x, l_discount * 100 AS y,
    CASE WHEN l_quantity <= 17 THEN 'low' WHEN l_quantity <= 34 THEN 'middle' ELSE 'high' END AS band, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL)
, size AS (SELECT band, sum(n) AS n FROM pts GROUP BY 1)
"""


def band_points(spark, sf):
    q, d = F.col("l_quantity"), F.col("l_discount") * 100
    return table(spark, sf, "lineitem").groupBy(
        F.concat_ws("/", q.cast("bigint").cast("string"), F.round(d).cast("bigint").cast("string")).alias("pt"),
        q.alias("x"), d.alias("y"),
        F.when(q <= 17, "low").when(q <= 34, "middle").otherwise("high").alias("band"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("silhouette_exact_bands", BANDS + """
, d AS (SELECT a.pt, a.band, a.n, b.band AS other, sum(b.n * sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS s FROM pts a, pts b GROUP BY ALL)
, m AS (SELECT pt, d.band, any_value(d.n) AS n, max(CASE WHEN other = d.band THEN s / (size.n - 1) END) AS a, min(CASE WHEN other <> d.band THEN s / size.n END) AS b
        FROM d JOIN size ON size.band = other GROUP BY pt, d.band)
SELECT band, sum(n)::BIGINT AS n, round(sum(n * (b - a) / greatest(a, b)) / sum(n), 6) AS silhouette FROM m GROUP BY band""")
def silhouette_exact_bands(spark, sf):
    s = X.silhouette_exact(band_points(spark, sf), "pt", ["x", "y"], "band")
    return s.groupBy("band").agg(
        F.sum("n").cast("bigint").alias("n"), rounded(F.sum(F.col("silhouette") * F.col("n")) / F.sum("n")).alias("silhouette")
    )


@query("silhouette_ml_bands", BANDS + """
, c AS (SELECT band, sum(n) AS w, sum(n * x) / sum(n) AS mx, sum(n * y) / sum(n) AS my, sum(n * (x * x + y * y)) / sum(n) AS ss FROM pts GROUP BY 1)
, d AS (SELECT a.pt, a.band, a.n, c.band AS other, c.w, a.x * a.x + a.y * a.y + c.ss - 2 * (a.x * c.mx + a.y * c.my) AS s FROM pts a, c)
, m AS (SELECT pt, band, any_value(n) AS n, max(CASE WHEN other = band THEN s * w / (w - n) END) AS a, min(CASE WHEN other <> band THEN s END) AS b FROM d GROUP BY pt, band)
SELECT round(sum(n * (b - a) / greatest(a, b)) / sum(n), 6) AS silhouette_squared FROM m""")
def silhouette_ml_bands(spark, sf):
    number = F.when(F.col("band") == "low", 0).when(F.col("band") == "middle", 1).otherwise(2)
    df = X.silhouette_ml(band_points(spark, sf).withColumn("c", number), ["x", "y"], "c")
    return df.withColumn("silhouette_squared", rounded("silhouette_squared"))
