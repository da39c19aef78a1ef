"""Answers against the rule table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanframe.functions.nulls import rounded
from gleanframe.operators import joins, rules as R
from gleanframe.plans.registry import query
from gleanframe.plans.sqlviews import with_views
from gleanframe.session import written
from gleanframe.sources.standins import mentions, rules

# the order status plays the part of the answer: F says yes, O says no, P does not know
ANSWERS = """
, answers AS (
  SELECT DISTINCT id, name, area, zone,
    CASE status WHEN 'F' THEN 'Yes, it is regulated' WHEN 'O' THEN 'No, no known regulation' ELSE 'IDK' END AS regulation FROM mentions)
, good AS (SELECT * FROM rules WHERE "grouping" = 'Protection' OR status_code = 'REGL')
, stacked AS (
  SELECT a.*, r."grouping", r.status_label FROM answers a LEFT JOIN (SELECT DISTINCT name, place, "grouping", status_label FROM good WHERE level = 'Département') r ON r.name = a.name AND strip_accents(translate(r.place, '-''', '  ')) = strip_accents(translate(a.area, '-''', '  '))
  UNION ALL
  SELECT a.*, r."grouping", r.status_label FROM answers a LEFT JOIN (SELECT DISTINCT name, place, "grouping", status_label FROM good WHERE level IN ('Région', 'Ancienne région')) r ON r.name = a.name AND strip_accents(translate(r.place, '-''', '  ')) = strip_accents(translate(a.zone, '-''', '  '))
  UNION ALL
  SELECT a.*, r."grouping", r.status_label FROM answers a LEFT JOIN (SELECT DISTINCT name, "grouping", status_label FROM good WHERE level IN ('État', 'Territoire')) r ON r.name = a.name)
, kept AS (
  SELECT DISTINCT id, name, area, zone, "grouping", status_label,
    CASE WHEN lower(regulation) LIKE '%yes%' THEN 'Yes' WHEN lower(regulation) LIKE '%no%' THEN 'No' ELSE regulation END AS regulation,
    CASE WHEN status_label IS NULL THEN 'No regulation/protection' WHEN status_label = 'Réglementation' THEN 'Regulation'
         WHEN contains(status_label, 'départementale') THEN 'Department-level protection'
         WHEN contains(status_label, 'nationale') THEN 'National-level protection'
         WHEN contains(status_label, 'régionale') THEN 'Regional-level protection' END AS status_group
  FROM (SELECT *, bool_or("grouping" IS NOT NULL) OVER (PARTITION BY name) AS any_rule FROM stacked)
  WHERE NOT any_rule OR "grouping" IS NOT NULL)
, final AS (
  SELECT k.*, CASE WHEN EXISTS (SELECT 1 FROM good g WHERE g.name = k.name) THEN 'At least 1 regulation or protection' END AS national_status
  FROM kept k)
"""
VIEWS = "mentions rules"
PLACES = {"department": "area", "region": "zone", "national": None}


def answers(spark, sf):
    said = F.when(F.col("status") == "F", "Yes, it is regulated").when(
        F.col("status") == "O", "No, no known regulation"
    ).otherwise("IDK")
    m = mentions(spark, sf, "id", "name", "area", "zone", "status")
    return m.select("id", "name", "area", "zone", said.alias("regulation")).distinct()


def final(spark, sf):
    # the rule table is an input file in real use: written once, read by every step
    return R.answers_with_status(answers(spark, sf), written(rules(spark, sf), "rules"), PLACES)


@query("multilevel_rules", with_views(VIEWS, ANSWERS + "SELECT * FROM final"))
def multilevel_rules(spark, sf):
    return final(spark, sf)


@query("regulation_shares", with_views(VIEWS, ANSWERS + """
SELECT regulation, status_group, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY regulation), 6) AS pct,
       round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct_all FROM final GROUP BY 1, 2"""))
def regulation_shares(spark, sf):
    return R.status_shares(final(spark, sf)).withColumns({c: rounded(c) for c in ("pct", "pct_all")})


@query("answer_shares", with_views(VIEWS, ANSWERS + """
SELECT regulation, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct FROM final GROUP BY 1"""))
def answer_shares(spark, sf):
    return R.answer_shares(final(spark, sf)).withColumn("pct", rounded("pct"))


@query("answer_scoring", with_views(VIEWS, ANSWERS + """
SELECT regulation, status_group, verdict, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY regulation), 6) AS pct
FROM (SELECT *, CASE WHEN regulation = 'Yes' AND status_group <> 'No regulation/protection' THEN 'Correct'
        WHEN regulation = 'No' AND status_group = 'No regulation/protection' THEN 'Correct' ELSE 'Incorrect' END AS verdict FROM final)
GROUP BY 1, 2, 3"""))
def answer_scoring(spark, sf):
    return R.verdict_shares(final(spark, sf)).withColumn("pct", rounded("pct"))


@query("regulated_elsewhere", with_views(VIEWS, ANSWERS + """
SELECT national_status, count(*) AS n FROM final WHERE regulation = 'Yes' AND status_group = 'No regulation/protection' GROUP BY 1"""))
def regulated_elsewhere(spark, sf):
    return R.regulated_elsewhere(final(spark, sf))


VOTES = """
, tagged AS (
  SELECT DISTINCT f.id, f.name, f.regulation, f.status_group, m.answer
  FROM final f LEFT JOIN (SELECT DISTINCT id, name, answer FROM mentions) m ON m.id = f.id AND m.name = f.name)
"""


def votes(spark, sf):
    tagged = final(spark, sf).select("id", "name", "regulation", "status_group").distinct()
    said = mentions(spark, sf, "id", "name", "answer").distinct()
    return joins.enrich(tagged, said, ["id", "name"]).distinct()


@query("unregulated_share", with_views(VIEWS, ANSWERS + VOTES + """
SELECT count(*) AS total_unsustainable, count(*) FILTER (status_group = 'No regulation/protection') AS unsustainable_unregulated,
       round(100.0::DOUBLE * count(*) FILTER (status_group = 'No regulation/protection') / count(*), 6) AS percent
FROM tagged WHERE answer = 'Unsustainable'"""))
def unregulated_share(spark, sf):
    return R.unregulated_share(votes(spark, sf)).withColumn("percent", rounded("percent"))


@query("unprotected_ratios", with_views(VIEWS, ANSWERS + VOTES + """
SELECT name, count(*) AS total_citations, count(*) FILTER (answer = 'Unsustainable') AS unsustainable_citations,
       round(avg(CASE WHEN answer = 'Unsustainable' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS ratio_unsustainable
FROM tagged WHERE status_group = 'No regulation/protection' GROUP BY name"""))
def unprotected_ratios(spark, sf):
    return R.unprotected_ratios(votes(spark, sf)).withColumn("ratio_unsustainable", rounded("ratio_unsustainable"))
