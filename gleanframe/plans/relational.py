"""Filters, joins, recodes and text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanframe.functions import nulls, text
from gleanframe.functions.nulls import rounded
from gleanframe.operators import joins, reshape
from gleanframe.plans.registry import query
from gleanframe.plans.sqlviews import with_views
from gleanframe.sources.standins import geography, mentions, mentions_nullable, profile, table


@query("filter_taxa", """
SELECT DISTINCT p_partkey AS code, p_name AS label, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'non-native' ELSE 'native' END AS origin
FROM part WHERE p_brand = 'Brand#7' AND p_type <> 'LARGE' AND p_size NOT IN (1, 2, 3) AND p_name IS NOT NULL""")
def filter_taxa(spark, sf):
    part = table(spark, sf, "part").filter(
        (F.col("p_brand") == "Brand#7") & (F.col("p_type") != "LARGE")
        & ~nulls.in_set("p_size", (1, 2, 3)) & F.col("p_name").isNotNull()
    )
    origin = F.when(nulls.in_set("p_type", ("PROMO", "SMALL")), "non-native").otherwise("native")
    return part.select(F.col("p_partkey").alias("code"), F.col("p_name").alias("label"), origin.alias("origin")).distinct()


@query("enrich_left", """
SELECT c_custkey, n_name, r_name, n_orders
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT o_custkey, o_orderpriority, count(*) AS n_orders FROM orders GROUP BY 1, 2) o
  ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'""")
def enrich_left(spark, sf):
    orders = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"))
    df = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.lit("1-URGENT").alias("priority"))
    df = joins.enrich(df, table(spark, sf, "nation"), {"c_nationkey": "n_nationkey"})
    df = joins.enrich(df, table(spark, sf, "region"), {"n_regionkey": "r_regionkey"})
    df = joins.enrich(df, orders, {"c_custkey": "o_custkey", "priority": "o_orderpriority"})
    return df.select("c_custkey", "n_name", "r_name", "n_orders")


@query("natural_join", with_views("mentions geography", """
SELECT area, name, n, zone FROM (SELECT area, name, count(*) AS n FROM mentions GROUP BY 1, 2) NATURAL LEFT JOIN geography"""))
def natural_join(spark, sf):
    counts = mentions(spark, sf, "area", "name").groupBy("area", "name").agg(F.count(F.lit(1)).alias("n"))
    return joins.natural_join(counts, geography(spark, sf))


@query("null_key_join", with_views("mentions mentions_nullable", """
, l AS (SELECT presence, count(*) AS n FROM mentions_nullable GROUP BY 1)
, r AS (SELECT presence, count(DISTINCT name) AS names FROM mentions_nullable GROUP BY 1)
SELECT l.presence, n, names FROM l LEFT JOIN r ON l.presence IS NOT DISTINCT FROM r.presence"""))
def null_key_join(spark, sf):
    m = mentions_nullable(spark, sf, "presence", "name")
    left = m.groupBy("presence").agg(F.count(F.lit(1)).alias("n"))
    right = m.distinct().groupBy("presence").agg(F.count("name").alias("names"))
    return joins.enrich(left, right, ["presence"], null_keys="match")


@query("full_join_profile", with_views("profile", """
SELECT coalesce(p.id, s.id) AS id, segment AS "PROFILE_segment", region AS "PROFILE_region",
       balance_band AS "PROFILE_balance_band", order_band AS "PROFILE_order_band", n_events AS "SPECIES_n_events"
FROM profile p FULL JOIN (SELECT user_id AS id, count(*) AS n_events FROM events GROUP BY 1) s ON p.id = s.id"""))
def full_join_profile(spark, sf):
    events = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n_events"))
    return joins.enrich(
        joins.prefix_columns(events, "SPECIES_", ["id"]),
        joins.prefix_columns(profile(spark, sf), "PROFILE_", ["id"]), ["id"], how="full",
    )


@query("group_any_filter", with_views("mentions mentions_nullable", """
, f AS (SELECT id, presence, life_form, bool_or(life_form IS NOT NULL AND presence = '1-URGENT') OVER (PARTITION BY id) AS hit
        FROM (SELECT DISTINCT id, presence, life_form FROM mentions_nullable))
SELECT id, presence, life_form FROM f WHERE NOT coalesce(hit, FALSE) OR (life_form IS NOT NULL AND presence = '1-URGENT')"""))
def group_any_filter(spark, sf):
    m = mentions_nullable(spark, sf, "id", "presence", "life_form").distinct()
    return joins.keep_matched_if_any(m, ["id"], F.col("life_form").isNotNull() & (F.col("presence") == "1-URGENT"))


@query("null_safe_if", with_views("mentions mentions_nullable", """
SELECT label, count(*) AS n FROM (
  SELECT CASE WHEN presence IS NULL THEN NULL WHEN presence = '1-URGENT' THEN life_form ELSE 'not urgent' END AS label
  FROM mentions_nullable) GROUP BY 1"""))
def null_safe_if(spark, sf):
    label = nulls.if_else(F.col("presence") == "1-URGENT", F.col("life_form"), "not urgent")
    m = mentions_nullable(spark, sf, "presence", "life_form")
    return m.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("strict_sums", with_views("mentions mentions_nullable", """
SELECT name, life_form, CASE WHEN count(*) = count(presence) THEN sum(CASE WHEN presence IS NOT NULL THEN line END) END::BIGINT AS strict_total,
       sum(CASE WHEN presence IS NOT NULL THEN line END)::BIGINT AS total FROM mentions_nullable GROUP BY 1, 2"""))
def strict_sums(spark, sf):
    m = mentions_nullable(spark, sf, "name", "life_form", "presence", "line")
    x = F.when(F.col("presence").isNotNull(), F.col("line"))
    return m.groupBy("name", "life_form").agg(nulls.strict_sum(x).alias("strict_total"), F.sum(x).alias("total"))


@query("recode_lookup", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Trend with risk' WHEN '2-HIGH' THEN 'Trend' ELSE o_orderpriority END AS kept,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Trend with risk' WHEN '2-HIGH' THEN 'Trend' END AS closed,
       regexp_replace(regexp_replace(o_orderpriority, '^[0-9]-', ''), 'LOW$', 'Low priority') AS cleaned FROM orders""")
def recode_lookup(spark, sf):
    labels = {"1-URGENT": "Trend with risk", "2-HIGH": "Trend"}
    p = F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        "o_orderkey", nulls.recode(p, labels).alias("kept"), nulls.recode(p, labels, unknown="null").alias("closed"),
        text.replace_chain(p, [("^[0-9]-", ""), ("LOW$", "Low priority")]).alias("cleaned"),
    )


@query("recode_pattern", """
SELECT doc_id, CASE WHEN contains(text, 'tion') THEN 'tion' WHEN contains(text, 'heit') THEN 'heit' WHEN contains(text, 'dad') THEN 'dad' ELSE lang END AS rule,
       CASE WHEN contains(lower(text), 'the ') THEN 'Yes' WHEN contains(lower(text), 'no') THEN 'No' ELSE 'Other' END AS answer,
       concat_ws('_', lang, source) AS tag
FROM documents""")
def recode_pattern(spark, sf):
    t = F.col("text")
    rule = F.when(t.contains("tion"), "tion").when(t.contains("heit"), "heit").when(t.contains("dad"), "dad")
    answer = nulls.recode_pattern(t, (("the ", "Yes"), ("no", "No")), ignore_case=True)
    return table(spark, sf, "documents").select(
        "doc_id", F.coalesce(rule, F.col("lang")).alias("rule"),
        F.when(answer.isin("Yes", "No"), answer).otherwise("Other").alias("answer"),
        F.concat_ws("_", "lang", "source").alias("tag"),
    )


@query("recode_across", """
SELECT p_partkey, upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS p_name, upper(left(p_brand, 1)) || lower(substr(p_brand, 2)) AS p_brand,
       upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS p_type FROM part""")
def recode_across(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return reshape.across(df, ["p_name", "p_brand", "p_type"], text.sentence_case)


@query("ordered_category", with_views("mentions", """
SELECT presence, CASE presence WHEN '1-URGENT' THEN 'A' WHEN '3-MEDIUM' THEN 'B' WHEN '5-LOW' THEN 'C' END AS letter,
       CAST(CASE presence WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 3 END AS INTEGER) AS ordinal,
       CASE WHEN presence IN ('1-URGENT', '3-MEDIUM', '5-LOW') THEN presence END AS closed, count(*) AS n
FROM mentions GROUP BY presence"""))
def ordered_category(spark, sf):
    levels = ("1-URGENT", "3-MEDIUM", "5-LOW")
    counts = mentions(spark, sf, "presence").groupBy("presence").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "presence", nulls.level_letter("presence", levels).alias("letter"),
        nulls.level_ordinal("presence", levels).alias("ordinal"), nulls.closed_set("presence", levels).alias("closed"), "n",
    )


@query("normalise_names", """
SELECT doc_id, translate(replace(strip_accents(text), 'ß', 'ss'), '-''', '  ') AS name FROM documents""")
def normalise_names(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalise_name("text").alias("name"))


@query("join_accent_blind", """
WITH c AS (SELECT c_custkey, n_name AS plain, CASE c_custkey % 3 WHEN 0 THEN n_name WHEN 1 THEN translate(n_name, 'AEIOU', 'ÀÉÎÖÜ')
    ELSE replace(replace(n_name, 'A', 'A' || chr(769)), 'U', 'U' || chr(776)) END AS spelled FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT n_nationkey, n_name, count(*) AS n, count(DISTINCT spelled) AS n_spellings FROM c JOIN nation ON strip_accents(spelled) = strip_accents(n_name) GROUP BY ALL""")
def join_accent_blind(spark, sf):
    """Customers whose nation is spelled plainly, with accents, or with combining marks, joined on the name."""
    nation, n = table(spark, sf, "nation").select("n_nationkey", "n_name"), F.col("n_name")
    marked = F.replace(F.replace(n, F.lit("A"), F.lit("A\u0301")), F.lit("U"), F.lit("U\u0308"))
    way = F.col("c_custkey") % 3
    spelled = F.when(way == 0, n).when(way == 1, F.translate(n, "AEIOU", "ÀÉÎÖÜ")).otherwise(marked)
    people = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(spelled.alias("spelled"))
    return people.join(nation, text.accent_blind("spelled") == text.accent_blind("n_name")).groupBy("n_nationkey", "n_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("spelled").alias("n_spellings")
    )


@query("rename_in_order", """
SELECT n_nationkey AS code, n_name AS label, n_regionkey AS area FROM nation""")
def rename_in_order(spark, sf):
    df = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return reshape.rename_in_order(df, ["code", "label", "area"])


@query("clean_text", r"""
SELECT doc_id, length(regexp_replace(text, '\(.*\)', '', 'g')) AS n_outside,
       md5(regexp_replace(text, '[aeiou]+', '_')) AS first_only, length(regexp_replace(text, '[\s]{2,}', ' ', 'g')) AS squeezed
FROM documents""")
def clean_text(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.length(text.remove_parenthesis(t, trim=False)).cast("bigint").alias("n_outside"),
        F.md5(text.replace_first(t, "[aeiou]+", "_")).alias("first_only"),
        F.length(F.regexp_replace(t, r"[\s]{2,}", " ")).cast("bigint").alias("squeezed"),
    )


@query("split_rows", r"""
SELECT doc_id, trim(unnest(regexp_split_to_array(text, ',\s*'))) AS part FROM documents""")
def split_rows(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.col("text").alias("part"))
    return reshape.split_rows(df, "part")


@query("unique_dimension", """
SELECT p_brand, min(p_type) AS first_type, count(*) AS n FROM (SELECT DISTINCT p_partkey, p_brand, p_type FROM part JOIN lineitem ON l_partkey = p_partkey) GROUP BY 1""")
def unique_dimension(spark, sf):
    seen = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    dim = joins.unique_dimension(seen.select("p_partkey", "p_brand", "p_type"), ["p_partkey"])
    return dim.groupBy("p_brand").agg(F.min("p_type").alias("first_type"), F.count(F.lit(1)).alias("n"))


@query("model_input", with_views("mentions mentions_nullable profile", """
SELECT name, CASE WHEN answer = 'Sustainable' THEN 0 ELSE 1 END AS y, segment, order_band, count(*) AS n
FROM (SELECT DISTINCT id, name, answer, presence FROM mentions_nullable WHERE presence IS NOT NULL) m JOIN profile USING (id)
GROUP BY ALL"""))
def model_input(spark, sf):
    m = mentions_nullable(spark, sf, "id", "name", "answer", "presence").dropna("any").distinct()
    y = F.when(F.col("answer") == "Sustainable", 0).otherwise(1)
    df = joins.enrich(m, profile(spark, sf), ["id"], how="inner")
    return df.groupBy("name", y.alias("y"), "segment", "order_band").agg(F.count(F.lit(1)).alias("n"))
