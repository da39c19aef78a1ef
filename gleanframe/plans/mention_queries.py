"""Ratios, rankings, curves and roll-ups over the mention view."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanframe.functions.nulls import rounded
from gleanframe.operators import joins, mentions as M, ordering, reshape, sketches
from gleanframe.plans.registry import query
from gleanframe.plans.sqlviews import with_views
from gleanframe.session import scratch_path
from gleanframe.sources.standins import geography, mentions, mentions_nullable, profile, table


@query("sustainability_ratio", with_views("mentions citations", """
SELECT name, life_form, round(avg(CASE WHEN answer = 'Unsustainable' THEN 1.0 ELSE 0.0 END), 6) AS ratio_unsustainable,
       count(*) AS total_citations
FROM (SELECT DISTINCT id, name, life_form, answer FROM mentions)
WHERE name IN (SELECT name FROM (SELECT name, rank() OVER (ORDER BY citations DESC) AS r FROM citations) WHERE r <= 20)
GROUP BY name, life_form"""))
def sustainability_ratio(spark, sf):
    df = M.sustainability_ratio(mentions(spark, sf, "id", "name", "life_form", "answer"), top=20)
    return df.withColumn("ratio_unsustainable", rounded("ratio_unsustainable"))


@query("rare_sustainability", with_views("mentions", """
SELECT * FROM (
  SELECT name, life_form, round(avg(CASE WHEN answer = 'Unsustainable' THEN 1.0 ELSE 0.0 END), 6) AS ratio_unsustainable,
         count(*) AS total_citations
  FROM (SELECT DISTINCT id, name, life_form, answer FROM mentions
        WHERE range_pct < 20 AND life_form IN ('ECONOMY', 'LARGE', 'MEDIUM', 'SMALL', 'STANDARD'))
  GROUP BY name, life_form)
WHERE ratio_unsustainable >= 0.3 AND ratio_unsustainable <= 0.45 AND total_citations BETWEEN 2 AND 200"""))
def rare_sustainability(spark, sf):
    native = ~F.coalesce(F.col("life_form") == "PROMO", F.lit(False))
    rare = mentions(spark, sf, "id", "name", "life_form", "answer", "range_pct").filter((F.col("range_pct") < 20) & native)
    df = M.sustainability_ratio(rare, min_ratio=0.3, max_ratio=0.45, min_citations=2, max_citations=200)
    return df.withColumn("ratio_unsustainable", rounded("ratio_unsustainable"))


@query("citations_having", with_views("mentions citations", "SELECT * FROM citations WHERE citations > 1"))
def citations_having(spark, sf):
    return M.citations(mentions(spark, sf, "id", "name")).filter("citations > 1")


@query("distinct_mentions", with_views("mentions votes", "SELECT * FROM votes"))
def distinct_mentions(spark, sf):
    return mentions(spark, sf, "id", "name", "answer", "area").distinct()


@query("complete_cases", with_views("mentions mentions_nullable", """
SELECT DISTINCT id, name, life_form, presence FROM mentions_nullable
WHERE id IS NOT NULL AND name IS NOT NULL AND life_form IS NOT NULL AND presence IS NOT NULL"""))
def complete_cases(spark, sf):
    return mentions_nullable(spark, sf, "id", "name", "life_form", "presence").dropna("any").distinct()


@query("pct_unsustainable", with_views("mentions", """
, p AS (
  SELECT name, count(*) FILTER (answer = 'Unsustainable') AS unsustainable,
         count(*) FILTER (answer = 'Sustainable') AS sustainable,
         round_even(100.0::DOUBLE * count(*) FILTER (answer = 'Unsustainable') / count(*), 2) AS ratio
  FROM (SELECT DISTINCT id, name, answer FROM mentions) GROUP BY name)
SELECT name, unsustainable, sustainable, ratio, (SELECT count(*) FROM p WHERE ratio > 50) AS names_above_50 FROM p"""))
def pct_unsustainable(spark, sf):
    df = M.unsustainable_percent(mentions(spark, sf, "id", "name", "answer"))
    above = df.agg(F.count_if(F.col("ratio") > 50)).scalar()
    return df.withColumn("names_above_50", above)


@query("pct_unsustainable_overall", with_views("mentions", """
SELECT round(avg(ratio), 6) AS mean_ratio,
       round_even(100.0::DOUBLE * avg(CASE WHEN ratio > 33 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 2) AS percent_above
FROM (SELECT name, round_even(100.0::DOUBLE * count(*) FILTER (answer = 'Unsustainable') / count(*), 2) AS ratio
      FROM mentions GROUP BY name)"""))
def pct_unsustainable_overall(spark, sf):
    per_name = M.unsustainable_percent(mentions(spark, sf, "name", "answer"), count_mode="rows")
    return M.share_above(per_name, cut=33.0).withColumn("mean_ratio", rounded("mean_ratio"))


@query("mentions_by_area", with_views("mentions votes cells", "SELECT * FROM cells"))
def mentions_by_area(spark, sf):
    return M.mentions_by_area(mentions(spark, sf, "id", "name", "answer", "area"))


@query("mentions_by_zone", with_views("mentions votes cells geography", """
SELECT name, zone, CAST(sum(unsustainable) AS BIGINT) AS unsustainable, CAST(sum(sustainable) AS BIGINT) AS sustainable,
       CAST(sum(total_citations) AS BIGINT) AS total_citations
FROM cells RIGHT JOIN geography USING (area) GROUP BY name, zone
HAVING name IS NOT NULL AND sum(total_citations) IS NOT NULL"""))
def mentions_by_zone(spark, sf):
    cells = M.mentions_by_area(mentions(spark, sf, "id", "name", "answer", "area"))
    return M.mentions_by_zone(cells, geography(spark, sf))


@query("mentions_grouping_sets", with_views("mentions votes cells geography", """
SELECT CASE WHEN grouping(name, area, zone) = 7 THEN 'all' ELSE
         concat_ws('+', CASE WHEN grouping(name) = 0 THEN 'name' END, CASE WHEN grouping(area) = 0 THEN 'area' END,
                   CASE WHEN grouping(zone) = 0 THEN 'zone' END) END AS level,
       name, area, zone, CAST(sum(unsustainable) AS BIGINT) AS unsustainable,
       CAST(sum(sustainable) AS BIGINT) AS sustainable, CAST(sum(total_citations) AS BIGINT) AS total_citations
FROM cells JOIN geography USING (area)
GROUP BY GROUPING SETS ((name, area), (name, zone), (area), (zone), ())"""))
def mentions_grouping_sets(spark, sf):
    cells = M.mentions_by_area(mentions(spark, sf, "id", "name", "answer", "area"))
    placed = joins.enrich(cells, geography(spark, sf), ["area"], how="inner")
    return M.mentions_rollup(placed, [["name", "area"], ["name", "zone"], ["area"], ["zone"], []])


@query("mean_ci_over_groups", with_views("mentions votes cells geography", """
SELECT round(avg(r), 6) AS mean, round(avg(r) - 1.96 * stddev_samp(r) / sqrt(count(*)), 6) AS ci_lower,
       round(avg(r) + 1.96 * stddev_samp(r) / sqrt(count(*)), 6) AS ci_upper
FROM (SELECT zone, 100.0::DOUBLE * sum(unsustainable) / sum(total_citations) AS r
      FROM cells JOIN geography USING (area) GROUP BY zone)"""))
def mean_ci_over_groups(spark, sf):
    cells = M.mentions_by_area(mentions(spark, sf, "id", "name", "answer", "area"))
    zones = M.sum_votes(M.mentions_by_zone(cells, geography(spark, sf)), ["zone"])
    per_zone = zones.withColumn("r", F.col("unsustainable") * 100.0 / F.col("total_citations"))
    return M.mean_with_interval(per_zone, "r").select(*[rounded(c).alias(c) for c in ("mean", "ci_lower", "ci_upper")])


@query("singleton_share", """
SELECT CAST(count(*) FILTER (n = 1) AS BIGINT) AS n_single, count(*) AS n_names,
       round(avg(CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share
FROM (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY 1, 2)""")
def singleton_share(spark, sf):
    names = table(spark, sf, "part").select("p_brand", "p_name")
    return M.singleton_share(names, ["p_brand", "p_name"]).withColumn("share", rounded("share"))


CURVE = """, curve AS (
  SELECT name, citations, CAST(sum(citations) OVER w AS BIGINT) AS cum_citations,
         sum(citations) OVER w / (SELECT sum(citations) FROM citations)::DOUBLE * 100 AS cum_percent,
         row_number() OVER (ORDER BY citations DESC, name) AS rank
  FROM citations WINDOW w AS (ORDER BY citations DESC, name ROWS UNBOUNDED PRECEDING))
"""


def curve(spark, sf):
    return M.cumulative_frequency(M.citations(mentions(spark, sf, "id", "name")))


@query("cumulative_frequency", with_views("mentions citations", CURVE + """
SELECT name, citations, cum_citations, round(cum_percent, 6) AS cum_percent, rank FROM curve"""))
def cumulative_frequency(spark, sf):
    return curve(spark, sf).withColumn("cum_percent", rounded("cum_percent"))


@query("cumulative_cutoffs", with_views("mentions citations", CURVE + """
SELECT cutoff::DOUBLE AS cutoff, min(rank) AS rank FROM curve, (VALUES (50), (80), (95)) c(cutoff)
WHERE cum_percent >= cutoff GROUP BY cutoff"""))
def cumulative_cutoffs(spark, sf):
    return M.cumulative_cutoffs(curve(spark, sf))


@query("knee_point", with_views("mentions citations", CURVE + """
, e AS (SELECT min(rank)::DOUBLE AS xa, max(rank)::DOUBLE AS xb, arg_min(cum_percent, rank) AS ya, arg_max(cum_percent, rank) AS yb FROM curve)
SELECT rank, round(cum_percent, 6) AS cum_percent FROM curve, e
ORDER BY round(cum_percent * (xb - xa) - rank * (yb - ya), 9) DESC, rank LIMIT 1"""))
def knee_point(spark, sf):
    return M.knee_point(curve(spark, sf)).withColumn("cum_percent", rounded("cum_percent"))


@query("topk_ties", with_views("mentions citations", """
SELECT name, citations FROM (SELECT *, rank() OVER (ORDER BY citations DESC) AS r FROM citations) WHERE r <= 10"""))
def topk_ties(spark, sf):
    return ordering.top_with_ties(M.citations(mentions(spark, sf, "id", "name")), "citations", 10)


@query("topk_exact", with_views("mentions votes cells", """
SELECT * FROM (SELECT * FROM cells ORDER BY total_citations DESC, area, name LIMIT 10)
UNION SELECT * FROM (SELECT * FROM cells ORDER BY unsustainable DESC, area, name LIMIT 10)"""))
def topk_exact(spark, sf):
    cells = M.mentions_by_area(mentions(spark, sf, "id", "name", "answer", "area"))
    best = [ordering.top_exact(cells, [F.desc(c), "area", "name"], 10) for c in ("total_citations", "unsustainable")]
    return best[0].unionByName(best[1]).distinct()


@query("daily_cumulative", """
SELECT strftime(day, '%Y-%m-%d') AS day, strftime(day, '%b %Y') AS month, n, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS cum_n
FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)""")
def daily_cumulative(spark, sf):
    return ordering.running_by_day(table(spark, sf, "events"), "ts").withColumn("day", F.col("day").cast("string"))


@query("profile_frequencies", with_views("mentions mentions_nullable", """
SELECT category, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS pct,
       CAST(row_number() OVER (ORDER BY CASE category WHEN 'LARGE' THEN 1 WHEN 'Prefer not to answer' THEN 2 ELSE 0 END, n DESC, category) AS INTEGER) AS position
FROM (SELECT coalesce(life_form, 'Prefer not to answer') AS category, count(DISTINCT id) AS n FROM mentions_nullable GROUP BY 1)"""))
def profile_frequencies(spark, sf):
    df = M.frequencies(mentions_nullable(spark, sf, "id", "life_form"), "life_form", last=("LARGE",))
    return df.withColumn("pct", rounded("pct"))


@query("frequencies_known", with_views("mentions mentions_nullable", """
SELECT category, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS pct, CAST(row_number() OVER (ORDER BY n DESC, category) AS INTEGER) AS position
FROM (SELECT life_form AS category, count(DISTINCT id) AS n FROM mentions_nullable WHERE life_form IS NOT NULL GROUP BY 1)"""))
def frequencies_known(spark, sf):
    df = M.frequencies(mentions_nullable(spark, sf, "id", "life_form"), "life_form", missing=None, last=())
    return df.withColumn("pct", rounded("pct"))


@query("contingency_pct", with_views("profile", """
SELECT segment, round_even(100.0::DOUBLE * count(*) FILTER (balance_band = 'debt') / count(*), 1) AS debt,
       round_even(100.0::DOUBLE * count(*) FILTER (balance_band = 'low') / count(*), 1) AS low,
       round_even(100.0::DOUBLE * count(*) FILTER (balance_band = 'middle') / count(*), 1) AS middle,
       round_even(100.0::DOUBLE * count(*) FILTER (balance_band = 'high') / count(*), 1) AS high
FROM profile GROUP BY segment"""))
def contingency_pct(spark, sf):
    return M.contingency_percent(profile(spark, sf), "segment", "balance_band", ["debt", "low", "middle", "high"]).drop("undeclared")


@query("contingency_undeclared", with_views("profile", """
SELECT segment, round_even(100.0::DOUBLE * count(*) FILTER (balance_band = 'debt') / count(*), 1) AS debt,
       round_even(100.0::DOUBLE * count(*) FILTER (balance_band = 'low') / count(*), 1) AS low,
       count(*) FILTER (balance_band NOT IN ('debt', 'low')) AS undeclared
FROM profile GROUP BY segment"""))
def contingency_undeclared(spark, sf):
    return M.contingency_percent(profile(spark, sf), "segment", "balance_band", ["debt", "low"])


@query("area_coverage", with_views("mentions geography", """
SELECT coalesce(m.area, g.area) AS area, n_answers, zone
FROM (SELECT area, count(DISTINCT id) AS n_answers FROM mentions GROUP BY area) m FULL JOIN geography g USING (area)"""))
def area_coverage(spark, sf):
    return M.area_coverage(mentions(spark, sf, "id", "area"), geography(spark, sf))


@query("area_total", with_views("mentions", """
SELECT sum(m) AS total_area FROM (SELECT area, max(range_pct) AS m FROM mentions GROUP BY area)"""))
def area_total(spark, sf):
    return M.area_total(mentions(spark, sf, "area", "range_pct"), "area", "range_pct")


@query("histogram_bins", with_views("mentions", """
, e AS (SELECT min(range_pct) AS lo, max(range_pct) AS hi FROM mentions)
SELECT answer, CAST(least(floor((range_pct - lo) / ((hi - lo) / 30.0::DOUBLE)), 29) AS INTEGER) AS bin, count(*) AS n
FROM mentions, e GROUP BY 1, 2"""))
def histogram_bins(spark, sf):
    return M.histogram(mentions(spark, sf, "answer", "range_pct"), "range_pct", ["answer"], 30)


@query("boxplot_stats", """
WITH q AS (SELECT n_name AS area, count(*) AS n, quantile_cont(s_acctbal, 0.25) AS q1, median(s_acctbal) AS med, quantile_cont(s_acctbal, 0.75) AS q3
  FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT area, n, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
       min(s_acctbal) FILTER (s_acctbal >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
       max(s_acctbal) FILTER (s_acctbal <= q3 + 1.5 * (q3 - q1)) AS whisker_high
FROM q JOIN nation ON area = n_name JOIN supplier ON s_nationkey = n_nationkey GROUP BY area, n, q1, med, q3""")
def boxplot_stats(spark, sf):
    df = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    box = M.boxplot(df.select(F.col("n_name").alias("area"), "s_acctbal"), ["area"], "s_acctbal")
    return box.withColumns({c: rounded(c) for c in ("q1", "median", "q3")})


@query("density_by_class", with_views("mentions", """
, v AS (SELECT answer, (range_pct - 0.0) / (51.0::DOUBLE / 63) AS pos, count(*) AS n FROM mentions GROUP BY 1, 2)
, s AS (SELECT answer, n, greatest(0, least(floor(pos), 62)) AS b, pos - greatest(0, least(floor(pos), 62)) AS f FROM v)
, bins AS (SELECT answer, b AS bin, n * (1 - f) AS w FROM s UNION ALL SELECT answer, b + 1, n * f FROM s)
, tot AS (SELECT answer, sum(n) AS total FROM v GROUP BY 1)
SELECT answer, round(point * (51.0::DOUBLE / 63), 6) AS x,
       round(sum(w * exp(-0.5 * pow((point - bin) * (51.0::DOUBLE / 63) / 2.5, 2)) / (2.5 * sqrt(2 * pi()))) / any_value(total), 6) AS density
FROM bins JOIN tot USING (answer), range(64) t(point) GROUP BY answer, point"""))
def density_by_class(spark, sf):
    df = M.density(mentions(spark, sf, "answer", "range_pct"), "answer", "range_pct", 0.0, 51.0, points=64, bandwidth=2.5)
    return df.withColumns({"x": rounded("x"), "density": rounded("density")}).drop("n_outside")


@query("density_within", with_views("mentions", """
, v AS (SELECT answer, range_pct BETWEEN 5 AND 40 AS held, (range_pct - 5.0) / (35.0::DOUBLE / 63) AS pos, count(*) AS n FROM mentions GROUP BY ALL)
, s AS (SELECT answer, n, greatest(0, least(floor(pos), 62)) AS b, pos - greatest(0, least(floor(pos), 62)) AS f FROM v WHERE held)
, bins AS (SELECT answer, b AS bin, n * (1 - f) AS w FROM s UNION ALL SELECT answer, b + 1, n * f FROM s)
, tot AS (SELECT answer, sum(n) FILTER (held) AS total, CAST(coalesce(sum(n) FILTER (NOT held), 0) AS BIGINT) AS n_outside FROM v GROUP BY 1)
SELECT answer, round(5 + point * (35.0::DOUBLE / 63), 6) AS x,
       round(sum(w * exp(-0.5 * pow((point - bin) * (35.0::DOUBLE / 63) / 2.5, 2)) / (2.5 * sqrt(2 * pi()))) / any_value(total), 6) AS density,
       any_value(n_outside) AS n_outside
FROM bins JOIN tot USING (answer), range(64) t(point) GROUP BY answer, point"""))
def density_within(spark, sf):
    df = M.density(mentions(spark, sf, "answer", "range_pct"), "answer", "range_pct", 5.0, 40.0, points=64, bandwidth=2.5)
    return df.withColumns({"x": rounded("x"), "density": rounded("density")})


@query("rarity_distribution", with_views("mentions", """
, pop AS (
  SELECT name, area, sum(range_pct) AS a FROM mentions GROUP BY 1, 2)
, tagged AS (
  SELECT a, 'no' AS in_survey FROM pop UNION ALL
  SELECT a, 'yes' FROM pop WHERE (name, area) IN (SELECT name, area FROM mentions WHERE answer = 'Unsustainable' AND line = 1))
SELECT in_survey, count(*) AS n, round(quantile_cont(a, 0.25), 6) AS q25, round(quantile_cont(a, 0.5), 6) AS q50,
       round(quantile_cont(a, 0.75), 6) AS q75 FROM tagged GROUP BY in_survey"""))
def rarity_distribution(spark, sf):
    m = mentions(spark, sf, "name", "area", "range_pct", "answer", "line")
    size = m.groupBy("name", "area").agg(
        F.sum("range_pct").alias("a"),
        F.bool_or((F.col("answer") == "Unsustainable") & (F.col("line") == 1)).alias("cited"),
    )
    tags = F.explode(F.when(F.col("cited"), F.array(F.lit("no"), F.lit("yes"))).otherwise(F.array(F.lit("no"))))
    q = ordering.quantiles(size.select("a", tags.alias("in_survey")), ["in_survey"], "a", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return q.withColumns({c: rounded(c) for c in ("q25", "q50", "q75")})


@query("window_share_of_total", with_views("mentions", """
, a AS (SELECT name, area, sum(range_pct) AS sp_area FROM mentions GROUP BY 1, 2)
, t AS (SELECT sum(m) AS total FROM (SELECT area, max(sp_area) AS m FROM a GROUP BY area))
SELECT name, area, sp_area, sum(sp_area) OVER (PARTITION BY name) AS sp_area_total,
       round(100 * sum(sp_area) OVER (PARTITION BY name) / total, 6) AS relative_area FROM a, t"""))
def window_share_of_total(spark, sf):
    from gleanframe.functions.nulls import strict_sum

    a = mentions(spark, sf, "name", "area", "range_pct").groupBy("name", "area").agg(F.sum("range_pct").alias("sp_area"))
    total = M.area_total(a, "area", "sp_area").scalar()
    df = joins.spread_group_value(a, ["name"], sp_area_total=strict_sum("sp_area"))
    return df.withColumn("relative_area", rounded(100 * F.col("sp_area_total") / total))


@query("overlap_lists", """
WITH a AS (SELECT DISTINCT concat(p_brand, ' ', p_name) AS label FROM part WHERE p_size < 25),
     b AS (SELECT DISTINCT concat(p_brand, ' ', p_name) AS label FROM part WHERE p_retailprice < 1000)
SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS n_both,
       (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS n_only_left,
       (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS n_only_right,
       round(100.0::DOUBLE * (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) / (SELECT count(*) FROM a), 6) AS pct_of_left,
       round(100.0::DOUBLE * (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) / (SELECT count(*) FROM b), 6) AS pct_of_right""")
def overlap_lists(spark, sf):
    from gleanframe.sources.standins import label_list

    df = joins.list_overlap(
        label_list(spark, sf, F.col("p_size") < 25), label_list(spark, sf, F.col("p_retailprice") < 1000), "label"
    )
    return df.withColumns({c: rounded(c) for c in ("pct_of_left", "pct_of_right")})


@query("list_difference", """
WITH a AS (SELECT DISTINCT concat(p_brand, ' ', p_name) AS label FROM part WHERE p_size < 25),
     b AS (SELECT DISTINCT concat(p_brand, ' ', p_name) AS label FROM part WHERE p_retailprice < 1000)
SELECT label, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT label, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def list_difference(spark, sf):
    from gleanframe.sources.standins import label_list

    return joins.list_difference(
        label_list(spark, sf, F.col("p_size") < 25), label_list(spark, sf, F.col("p_retailprice") < 1000), "label"
    )


@query("map_layer", with_views("mentions votes cells geography", """
SELECT g.area, g.zone, c.name, c.sustainable, c.unsustainable, c.total_citations,
       round_even(100.0::DOUBLE * unsustainable / total_citations, 2) AS prop_unsustainable,
       (SELECT max(total_citations) FROM cells) AS global_max,
       CAST(CASE WHEN round_even(100.0::DOUBLE * unsustainable / total_citations, 2) < 25 THEN 1
            WHEN round_even(100.0::DOUBLE * unsustainable / total_citations, 2) < 50 THEN 2
            WHEN round_even(100.0::DOUBLE * unsustainable / total_citations, 2) < 75 THEN 3
            WHEN round_even(100.0::DOUBLE * unsustainable / total_citations, 2) <= 100 THEN 4 END AS INTEGER) AS step
FROM geography g LEFT JOIN (SELECT * FROM cells WHERE name = 'Brand#7') c USING (area)"""))
def map_layer(spark, sf):
    cells = M.mentions_by_area(mentions(spark, sf, "id", "name", "answer", "area"))
    return M.map_layer(geography(spark, sf), cells, ["area"], name="Brand#7")


@query("map_layer_all", with_views("mentions votes cells geography", """
, sums AS (SELECT area, CAST(sum(sustainable) AS BIGINT) AS sustainable, CAST(sum(unsustainable) AS BIGINT) AS unsustainable,
                  CAST(sum(total_citations) AS BIGINT) AS total_citations FROM cells GROUP BY area)
, p AS (SELECT *, round_even(100.0::DOUBLE * unsustainable / total_citations, 2) AS prop_unsustainable FROM sums)
SELECT g.area, g.zone, sustainable, unsustainable, total_citations, prop_unsustainable, (SELECT max(total_citations) FROM sums) AS global_max,
       CAST(CASE WHEN prop_unsustainable < 25 THEN 1 WHEN prop_unsustainable < 50 THEN 2 WHEN prop_unsustainable < 75 THEN 3
                 WHEN prop_unsustainable <= 100 THEN 4 END AS INTEGER) AS step
FROM geography g LEFT JOIN p USING (area)"""))
def map_layer_all(spark, sf):
    cells = M.mentions_by_area(mentions(spark, sf, "id", "name", "answer", "area"))
    return M.map_layer(geography(spark, sf), cells, ["area"])


@query("survey_counts_wide", with_views("mentions", """
SELECT name, life_form, count(*) FILTER (answer = 'Sustainable') AS "Sustainable", count(*) FILTER (answer = 'Unsustainable') AS "Unsustainable"
FROM mentions GROUP BY 1, 2"""))
def survey_counts_wide(spark, sf):
    m = mentions(spark, sf, "name", "life_form", "answer")
    return reshape.category_counts(m, ["name", "life_form"], "answer", ["Sustainable", "Unsustainable"])


@query("sketch_rollup", with_views("mentions", """
, l AS (SELECT 'area' AS level, area, zone, id FROM mentions UNION ALL SELECT 'zone', NULL, zone, id FROM mentions UNION ALL SELECT 'all', NULL, NULL, id FROM mentions)
SELECT level, area, zone, count(*) AS "rows", count(DISTINCT id) AS ids, true AS ids_within, true AS median_within FROM l GROUP BY level, area, zone"""))
def sketch_rollup(spark, sf):
    """Every level from stored cells; estimates are held against exact numbers, within the errors stated."""
    rows = mentions(spark, sf, "area", "zone", "id", "range_pct")
    path = scratch_path(spark, "cells")
    sketches.sketch_cells(rows, ["area", "zone"], "id", "range_pct").write.parquet(path)
    cells, out = spark.read.parquet(path), None
    for level, by in (("area", ["area", "zone"]), ("zone", ["zone"]), ("all", [])):
        cells = sketches.merge_cells(cells, by)
        told = cells.select(*by, "rows", sketches.distinct_estimate().alias("about"), sketches.quantile_estimate(0.5).alias("middle"))
        # exact numbers, from the rows
        joined = joins.enrich(rows, told, by, how="inner") if by else rows.withColumns({c: told.select(c).scalar() for c in told.columns})
        value = F.col("range_pct").cast("double")
        exact = joined.groupBy(*by, "rows", "about", "middle").agg(
            F.count_distinct("id").alias("ids"), (F.count_if(value < F.col("middle")) / F.count("range_pct")).alias("low"),
            (F.count_if(value <= F.col("middle")) / F.count("range_pct")).alias("high"),
        )
        place = {c: F.col(c) if c in by else F.lit(None).cast("string") for c in ("area", "zone")}
        within = F.abs(F.col("about") - F.col("ids")) <= F.greatest(F.lit(1.0), sketches.DISTINCT_ERROR * F.col("ids"))
        reached = (F.col("low") - sketches.RANK_ERROR <= 0.5) & (F.col("high") + sketches.RANK_ERROR >= 0.5)
        part = exact.select(
            F.lit(level).alias("level"), *[v.alias(c) for c, v in place.items()], "rows", "ids", within.alias("ids_within"), reached.alias("median_within")
        )
        out = part if out is None else out.unionByName(part)
    return out
