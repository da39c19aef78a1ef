"""The stand-in views in SQL, for the checking database."""

from __future__ import annotations

from gleanframe.sources.questionnaire import wide_survey_sql

VIEWS = {
    "mentions": """
        SELECT o_custkey AS id, p_brand AS name, n_name AS area, r_name AS zone, p_type AS life_form,
               CASE WHEN l_returnflag = 'R' THEN 'Unsustainable' ELSE 'Sustainable' END AS answer,
               o_orderpriority AS presence, o_orderstatus AS status, l_quantity AS range_pct, l_linenumber AS line
        FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey
        JOIN part ON l_partkey = p_partkey
        JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "mentions_nullable": """
        SELECT * REPLACE (nullif(presence, '4-NOT SPECIFIED') AS presence, nullif(life_form, 'PROMO') AS life_form)
        FROM mentions""",
    "geography": "SELECT n_name AS area, r_name AS zone FROM nation JOIN region ON n_regionkey = r_regionkey",
    "citations": """
        SELECT name, count(*) AS citations FROM (SELECT DISTINCT id, name FROM mentions) GROUP BY name""",
    "votes": "SELECT DISTINCT id, name, answer, area FROM mentions",
    "cells": """
        SELECT area, name,
               CAST(sum(CASE WHEN answer = 'Sustainable' THEN 1 ELSE 0 END) AS BIGINT) AS sustainable,
               CAST(sum(CASE WHEN answer = 'Unsustainable' THEN 1 ELSE 0 END) AS BIGINT) AS unsustainable,
               count(*) AS total_citations
        FROM votes GROUP BY area, name""",
    "profile": """
        SELECT c_custkey AS id, c_mktsegment AS segment, r_name AS region,
               CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 3000 THEN 'low'
                    WHEN c_acctbal < 6000 THEN 'middle' ELSE 'high' END AS balance_band,
               CASE WHEN coalesce(n, 0) < 8 THEN 'few orders' WHEN coalesce(n, 0) < 12 THEN 'some orders'
                    ELSE 'many orders' END AS order_band
        FROM customer
        JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey""",
    "rules": """
        SELECT DISTINCT p_brand AS name, level, CASE level WHEN 'Département' THEN translate(n_name, 'E ', 'É-') WHEN 'Région' THEN translate(r_name, 'E ', 'É-') ELSE 'France' END AS place,
               status_label, grouping_ AS "grouping", status_code
        FROM lineitem
        JOIN part ON l_partkey = p_partkey
        JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey
        JOIN (VALUES
            ('a', 'Département', 'Protection départementale', 'Protection', 'PD'),
            ('b', 'Région', 'Protection régionale', 'Protection', 'PR'),
            ('c', 'État', 'Protection nationale', 'Protection', 'PN'),
            ('d', 'État', 'Réglementation', 'Réglementation', 'REGL'),
            ('e', 'État', 'Liste rouge', 'Listes rouges', 'LRN')
        ) v(k, level, status_label, grouping_, status_code)
          ON (k = 'a' AND l_tax = 0.08 AND l_quantity >= 49 AND p_brand LIKE 'Brand#1%')
          OR (k = 'b' AND l_tax = 0.0 AND l_quantity = 1 AND p_brand LIKE 'Brand#2%')
          OR (k = 'c' AND l_tax = 0.0 AND l_quantity = 2 AND p_brand LIKE 'Brand#3%')
          OR (k = 'd' AND l_tax = 0.0 AND l_quantity = 3 AND p_brand LIKE 'Brand#4%')
          OR (k = 'e' AND l_tax = 0.0 AND l_quantity = 4)""",
    "wide_survey": wide_survey_sql(),
    "parcels": """
        SELECT c_custkey AS parcel, c_mktsegment AS owner,
               (c_custkey % 64) * 10.0::DOUBLE AS x, (c_custkey // 64) * 10.0::DOUBLE AS y
        FROM customer""",
}


def with_views(names: str, body: str) -> str:
    """``body`` behind the named views, in the order given."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names.split())
    return f"WITH {ctes}\n{body}"
