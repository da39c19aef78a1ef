"""Questionnaire reshaping, from the wide export to the fact table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanframe.operators import joins, reshape, survey as S
from gleanframe.plans.registry import query
from gleanframe.plans.sqlviews import with_views
from gleanframe.sources.questionnaire import GROUP_FILLED, wide_survey
from gleanframe.sources.standins import table

GROUPS = tuple(GROUP_FILLED)
KNOWN = "GsuppQsupp____Known_unsustainable"

LONG = r"""
, long AS (
  SELECT id, CAST(regexp_extract(column_name, '^G(\d+)Q0{3,4}(\d+)_', 1) AS INTEGER) AS grp,
         CAST(regexp_extract(column_name, '^G(\d+)Q0{3,4}(\d+)_', 2) AS INTEGER) AS qcode, column_name, value
  FROM (UNPIVOT wide_survey ON COLUMNS('^G\d+Q') INTO NAME column_name VALUE value))
"""
FIELDS = """
, fields(field, q1, q2) AS (VALUES ('name', 1, 1), ('dpt', 2, 4), ('presence', 4, 6), ('harv_spread', 5, 7), ('start_obs', 10, 12),
  ('state_resource', 11, 13), ('harv_variation', 12, 14), ('harv_intensity', 13, 15), ('market_trend', 18, 20),
  ('market_trend_risk', 19, 21), ('species_regulation', 20, 22), ('regulation_adapted', 21, 23),
  ('harv_parts', 6, 8), ('uses', 7, 9), ('risk', 17, 19), ('harv_type', 8, 10), ('company_type', 9, 11), ('unadapted_regulation_cause', 22, 24))
, typed AS (
  SELECT l.*, field FROM long l JOIN fields ON qcode = CASE WHEN grp IN (3, 4) THEN q1 ELSE q2 END WHERE grp <> 21)
, flag AS (
  SELECT id, grp, CASE WHEN grp = 3 THEN 'Sustainable' WHEN grp = 4 THEN 'Unsustainable'
           WHEN arg_min(value, column_name) FILTER (qcode = 2) = 'Yes' THEN 'Sustainable' ELSE 'Unsustainable' END AS sustainability
  FROM long WHERE grp <> 21 GROUP BY id, grp)
"""
SINGLE = tuple(S.SINGLE_FIELDS)
CELLS = """
, lists AS (SELECT id, grp, field, list(value ORDER BY column_name) AS vals FROM typed GROUP BY ALL)
, packed AS (SELECT id, grp, %s FROM lists GROUP BY id, grp)
, long_names AS (
  SELECT DISTINCT id, grp, trim(unnest(regexp_split_to_array(name[1], ',\\s*'))) AS name FROM packed)
, tidy AS (
  SELECT DISTINCT id, grp, n.name, f.sustainability, %s
  FROM packed p JOIN flag f USING (id, grp) JOIN long_names n USING (id, grp),
       range(1, 3) r(i)
  WHERE i <= greatest(1, %s) AND n.name <> '')
""" % (
    ", ".join(f"any_value(vals) FILTER (field = '{f}') AS {f}" for f in SINGLE),
    ", ".join(f"CASE WHEN len(p.{f}) = 1 THEN p.{f}[1] ELSE p.{f}[i] END AS {f}" for f in SINGLE if f != "name"),
    ", ".join(f"coalesce(len(p.{f}), 0)" for f in SINGLE if f != "name"),
)
LABEL = "upper(left(replace(regexp_replace(column_name, '.*____', ''), '_', ' '), 1)) || lower(substr(replace(regexp_replace(column_name, '.*____', ''), '_', ' '), 2))"
CHOICE = f"""
, ticked AS (SELECT id, grp, field, column_name, {LABEL} AS label FROM typed WHERE value = 'Yes' AND field IN ('harv_parts', 'uses', 'risk'))
"""
OTHER_COLUMNS = {
    "harv_type": ("harv_type_Individual", "harv_type_Collective", "harv_type_other"),
    "company_type": ("company_type_Small_company", "company_type_Large_company", "company_type_other"),
    "unadapted_regulation_cause": (
        "unadapted_regulation_cause_Too_strict", "unadapted_regulation_cause_Not_enforced", "unadapted_regulation_cause_other",
    ),
}
OTHER = """
, named AS (
  SELECT id, grp, field, value, CASE WHEN column_name LIKE '%Other' THEN field || '_other'
         ELSE regexp_replace(field || '_' || regexp_replace(column_name, '.*____', ''), '_{2,}', '_', 'g') END AS col
  FROM typed WHERE field IN ('harv_type', 'company_type', 'unadapted_regulation_cause'))
"""


def _other_cells(fields=tuple(OTHER_COLUMNS)):
    return ", ".join(f"any_value(value) FILTER (col = '{c}') AS {c}" for f in fields for c in OTHER_COLUMNS[f])


@query("survey_unpivot", with_views("wide_survey", LONG + FIELDS + """
SELECT grp AS "group", qcode, value, count(*) AS n FROM typed WHERE field IN (%s) GROUP BY ALL""" % ", ".join(f"'{f}'" for f in SINGLE)))
def survey_unpivot(spark, sf):
    df = wide_survey(spark, sf)
    cells = S.field_cells(S.catalogue(df.columns), S.SINGLE_FIELDS, GROUPS)
    long = S.answers_long(df, [q for _, q in cells])
    return long.groupBy("group", "qcode", "value").agg(F.count(F.lit(1)).alias("n"))


@query("survey_unpivot_generic", with_views("wide_survey", LONG + """
SELECT column_name, value, count(*) AS n FROM long WHERE grp = 21 GROUP BY ALL"""))
def survey_unpivot_generic(spark, sf):
    df = wide_survey(spark, sf)
    long = reshape.to_long(df, ["id"], [c for c in df.columns if c.startswith("G21Q")])
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def _long_typed(spark, sf, fields):
    df = wide_survey(spark, sf)
    questions = S.catalogue(df.columns)
    cells = S.field_cells(questions, fields, GROUPS)
    # the sustainability question rides along in the further groups
    flags = [q for g in GROUPS if g not in S.FIRST_GROUPS for q in S.pick(questions, g, S.SUSTAINABLE_QUESTION)]
    long = S.sustainability_flag(S.answers_long(df, [q for _, q in cells] + flags))
    kind = None
    for f, numbers in fields.items():
        hit = F.col("qcode") == F.when(F.col("group").isin(*S.FIRST_GROUPS), numbers[0]).otherwise(numbers[1])
        kind = F.when(hit, f) if kind is None else kind.when(hit, f)
    return long.withColumn("type", kind).filter(F.col("type").isNotNull())


@query("survey_widen", with_views("wide_survey", LONG + FIELDS + CELLS + """
SELECT id, grp AS "group", sustainability, name, dpt, presence, market_trend FROM (
  SELECT DISTINCT p.id, p.grp, f.sustainability, p.name[1] AS name, p.dpt[1] AS dpt, p.presence[1] AS presence,
    CASE WHEN len(p.market_trend) = 1 THEN p.market_trend[1] ELSE p.market_trend[i] END AS market_trend, i
  FROM packed p JOIN flag f USING (id, grp), range(1, 3) r(i) WHERE i <= greatest(1, coalesce(len(p.market_trend), 0)))"""))
def survey_widen(spark, sf):
    fields = {f: S.SINGLE_FIELDS[f] for f in ("name", "dpt", "presence", "market_trend")}
    ids = ["id", "group", "sustainability"]
    wide = reshape.widen_lists(_long_typed(spark, sf, fields), ids, "type", "value", "ordinal", list(fields))
    return reshape.unnest_parallel(wide, list(fields))


@query("survey_widen_single", with_views("wide_survey", LONG + FIELDS + """
SELECT id, grp AS "group", arg_min(value, column_name) FILTER (field = 'market_trend') AS market_trend,
       arg_min(value, column_name) FILTER (field = 'presence') AS presence
FROM typed WHERE field IN ('market_trend', 'presence') GROUP BY id, grp"""))
def survey_widen_single(spark, sf):
    fields = {f: S.SINGLE_FIELDS[f] for f in ("market_trend", "presence")}
    return reshape.widen_first(_long_typed(spark, sf, fields), ["id", "group"], "type", "value", "ordinal", list(fields))


@query("sustainability_flag", with_views("wide_survey", LONG + FIELDS + """
SELECT id, grp AS "group", sustainability FROM flag JOIN (SELECT DISTINCT id, grp FROM typed WHERE field = 'name') USING (id, grp)"""))
def sustainability_flag(spark, sf):
    long = _long_typed(spark, sf, {"name": S.SINGLE_FIELDS["name"]})
    return long.select("id", "group", "sustainability").distinct()


@query("propagate_any", with_views("wide_survey", LONG + FIELDS + f"""
SELECT id, grp AS "group", CASE WHEN bool_or(sustainability = 'Unsustainable') OVER (PARTITION BY id) THEN 'Yes' ELSE known END AS known
FROM flag JOIN (SELECT DISTINCT id, grp FROM typed WHERE field = 'name') USING (id, grp)
JOIN (SELECT id, "{KNOWN}" AS known FROM wide_survey) USING (id)"""))
def propagate_any(spark, sf):
    flags = sustainability_flag(spark, sf)
    known = wide_survey(spark, sf).select("id", F.col(KNOWN).alias("known"))
    rows = joins.enrich(flags, known, ["id"])
    bad = F.col("sustainability") == "Unsustainable"
    return joins.propagate_any(rows, ["id"], bad, "known", "Yes").select("id", "group", "known")


@query("survey_multichoice", with_views("wide_survey", LONG + FIELDS + CHOICE + """
SELECT id, grp AS "group", label AS harv_parts FROM ticked WHERE field = 'harv_parts'"""))
def survey_multichoice(spark, sf):
    df = wide_survey(spark, sf)
    return S.multichoice(df, S.catalogue(df.columns), S.CHOICE_FIELDS["harv_parts"], GROUPS, "harv_parts")


@query("survey_multichoice_other", with_views("wide_survey", LONG + FIELDS + OTHER + f"""
SELECT id, grp AS "group", {_other_cells(("company_type",))} FROM named WHERE field = 'company_type' GROUP BY id, grp"""))
def survey_multichoice_other(spark, sf):
    df = wide_survey(spark, sf)
    return S.multichoice_other(df, S.catalogue(df.columns), S.CHOICE_OTHER_FIELDS["company_type"], GROUPS, "company_type")


@query("survey_multichoice_by_id", with_views("wide_survey", LONG + FIELDS + OTHER + """
SELECT id, CAST(min(grp) AS INTEGER) AS "group", %s FROM named WHERE field = 'harv_type' GROUP BY id""" % ", ".join(
    f"arg_min(value, grp) FILTER (col = '{c}') AS {c}" for c in OTHER_COLUMNS["harv_type"])))
def survey_multichoice_by_id(spark, sf):
    df = wide_survey(spark, sf)
    return S.multichoice_other(
        df, S.catalogue(df.columns), S.CHOICE_OTHER_FIELDS["harv_type"], GROUPS, "harv_type", legacy=True
    )


@query("coalesce_rows", with_views("wide_survey", LONG + FIELDS + """
SELECT id, arg_min(value, grp) FILTER (field = 'presence') AS presence, arg_min(value, grp) FILTER (field = 'harv_intensity') AS harv_intensity
FROM typed WHERE field IN ('presence', 'harv_intensity') GROUP BY id"""))
def coalesce_rows(spark, sf):
    fields = {f: S.SINGLE_FIELDS[f] for f in ("presence", "harv_intensity")}
    long = _long_typed(spark, sf, fields)
    rows = long.select("id", "group", *[F.when(F.col("type") == f, F.col("value")).alias(f) for f in fields])
    return reshape.coalesce_rows(rows, ["id"], "group")


@query("pivot_flags", with_views("wide_survey", LONG + FIELDS + CHOICE + """
SELECT id, grp AS "group", CASE WHEN bool_or(label = 'Leaves') THEN 'Yes' ELSE 'Non' END AS "parts_Leaves",
       CASE WHEN bool_or(label = 'Flowers') THEN 'Yes' ELSE 'Non' END AS "parts_Flowers", CASE WHEN bool_or(label = 'Bark') THEN 'Yes' ELSE 'Non' END AS "parts_Bark"
FROM ticked WHERE field = 'harv_parts' GROUP BY id, grp"""))
def pivot_flags(spark, sf):
    return reshape.presence_flags(
        survey_multichoice(spark, sf), ["id", "group"], "harv_parts", ["Leaves", "Flowers", "Bark"], "parts_", fill="Non"
    )


@query("drop_empty_cols", with_views("wide_survey", """
SELECT id, "G21Q00016____Size", "G21Q00017____Nb_org_species" FROM wide_survey"""))
def drop_empty_cols(spark, sf):
    df = wide_survey(spark, sf)
    return reshape.drop_empty_columns(df.select("id", *[c for c in df.columns if c[:8] in ("G21Q0001",) and c[8] in "678"]))


MENTION_COLUMNS = (
    "id", "group", "known_unsustainable", "sustainability", "name", "dpt", "presence", "harv_spread", "start_obs", "state_resource",
    "harv_variation", "harv_intensity", "market_trend", "market_trend_risk", "species_regulation", "regulation_adapted",
)
MENTION_ROWS = LONG + FIELDS + CELLS + CHOICE + OTHER + f"""
, others AS (SELECT id, grp, {_other_cells()} FROM named GROUP BY id, grp)
, choices AS (SELECT id, grp, %s FROM ticked GROUP BY id, grp)
, bad AS (SELECT id, bool_or(sustainability = 'Unsustainable') AS bad FROM tidy GROUP BY id)
, mention_rows AS (
  SELECT DISTINCT t.id, t.grp AS "group", CASE WHEN bad THEN 'Yes' ELSE w."{KNOWN}" END AS known_unsustainable, sustainability, name,
    translate(CASE WHEN d IN ('Essonne', 'Hauts-de-Seine', 'Paris', 'Seine-Saint-Denis', 'Seine-et-Marne', 'Val-d''Oise', 'Val-de-Marne', 'Yvelines')
         THEN 'Ile-de-France' ELSE d END, '-''', '  ') AS dpt,
    presence, harv_spread, start_obs, state_resource, harv_variation, harv_intensity, market_trend, market_trend_risk,
    species_regulation, regulation_adapted, harv_parts, uses, risk, {", ".join(c for cs in OTHER_COLUMNS.values() for c in cs)}
  FROM (SELECT *, trim(regexp_replace(dpt, '\\s*\\([0-9AB]+\\)', '')) AS d FROM tidy) t
  JOIN bad USING (id) JOIN wide_survey w USING (id)
  LEFT JOIN choices c ON c.id = t.id AND c.grp = t.grp LEFT JOIN others o ON o.id = t.id AND o.grp = t.grp)
""" % ", ".join(f"list(label ORDER BY column_name) FILTER (field = '{f}') AS {f}" for f in ("harv_parts", "uses", "risk"))


def mention_rows(spark, sf):
    return S.mention_pipeline(wide_survey(spark, sf), GROUPS, known=KNOWN)


@query("mention_pipeline", with_views("wide_survey", MENTION_ROWS + """
SELECT * REPLACE (coalesce(array_to_string(harv_parts, '|'), '') AS harv_parts, coalesce(array_to_string(uses, '|'), '') AS uses,
                  coalesce(array_to_string(risk, '|'), '') AS risk) FROM mention_rows"""))
def mention_pipeline(spark, sf):
    return mention_rows(spark, sf).withColumns({c: F.concat_ws("|", c) for c in ("harv_parts", "uses", "risk")})


@query("survey_fanout", with_views("wide_survey", MENTION_ROWS + """
, f AS (
  SELECT name, sustainability, p, u, r FROM mention_rows,
    LATERAL (SELECT unnest(coalesce(harv_parts, [NULL])) AS p), LATERAL (SELECT unnest(coalesce(uses, [NULL])) AS u),
    LATERAL (SELECT unnest(coalesce(risk, [NULL])) AS r))
SELECT name, sustainability, p AS harv_parts, u AS uses, r AS risk, count(*) AS n FROM f GROUP BY ALL"""))
def survey_fanout(spark, sf):
    rows = S.fan_out(mention_rows(spark, sf), ["harv_parts", "uses", "risk"])
    return rows.groupBy("name", "sustainability", "harv_parts", "uses", "risk").agg(F.count(F.lit(1)).alias("n"))


PROFILE_SQL = LONG + """
, pf(field, q) AS (VALUES ('gender', 1), ('age', 2), ('evt_studies', 4), ('harvester', 6), ('harvesting_start', 7), ('nb_harv_species', 8),
  ('harvester_status', 9), ('harvester_status_company', 10), ('harv_group', 11), ('name_harv_group', 12),
  ('name_affiliated_organisation', 14), ('job_in_affiliated_organisation', 15), ('size_affiliated_organisation', 16),
  ('nb_species_affiliated_organisation', 17))
, pcols AS (
  SELECT id, field AS col, value FROM long JOIN pf ON qcode = q WHERE grp = 21
  UNION ALL
  SELECT id, CASE qcode WHEN 3 THEN 'education_level' WHEN 5 THEN 'socio_pro_category' ELSE 'affiliated_organisation_type' END || '_' ||
         CASE WHEN column_name LIKE '%Other' THEN 'other' ELSE regexp_replace(column_name, '.*____', '') END, value
  FROM long WHERE grp = 21 AND qcode IN (3, 5, 13))
"""
PROFILE_COLUMNS = tuple(S.PROFILE_FIELDS) + (
    "education_level_Secondary", "education_level_University", "education_level_other",
    "socio_pro_category_Farmers", "socio_pro_category_Retired", "socio_pro_category_other",
    "affiliated_organisation_type_No_affiliated_organisation", "affiliated_organisation_type_Buyer_of_wild_plants",
    "affiliated_organisation_type_other",
)
PROFILE_ROWS = PROFILE_SQL + """
, profile_rows AS (SELECT id, %s FROM pcols GROUP BY id HAVING count(*) FILTER (col IN (SELECT field FROM pf)) > 0)
""" % ", ".join(f"any_value(value) FILTER (col = '{c}') AS {c}" for c in PROFILE_COLUMNS)


@query("profile_pipeline", with_views("wide_survey", PROFILE_ROWS + "SELECT * FROM profile_rows"))
def profile_pipeline(spark, sf):
    return S.profile_pipeline(wide_survey(spark, sf))


USES = ("Food", "Medical", "Craft", "Ornamental")


def _clean(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({c}, 'I don''t know', 'IDK'), '\(.*\)', '', 'g'))"


def _trend(c: str) -> str:
    return (
        f"CASE WHEN contains({c}, 'variable') THEN 'Variable' WHEN contains({c}, 'stable') THEN 'Stable' "
        f"WHEN contains({c}, 'decrease') THEN 'Decrease' WHEN contains({c}, 'increase') THEN 'Increase' ELSE {c} END"
    )


def _fact_sql() -> str:
    special = {
        "SPECIES_market_trend": "CASE WHEN market_trend IS NULL THEN NULL WHEN market_trend = 'Yes' THEN CASE market_trend_risk WHEN 'Yes' THEN 'Trend with risk' WHEN 'No' THEN 'Trend without risk' END ELSE 'No trend' END",
        "PROFILE_harvester_status": "CASE WHEN harvester IS NULL THEN NULL WHEN harvester = 'Yes' THEN CASE WHEN contains(harvester_status, 'leisure') THEN 'Recreational' WHEN contains(harvester_status, 'income') THEN 'Professional' ELSE harvester_status END ELSE 'Non-harvester' END",
        "PROFILE_nb_harv_species": "coalesce(nb_harv_species, '0')",
    }
    cells = []
    for c in PROFILE_COLUMNS:
        if c != "harvester":
            cells.append((f"PROFILE_{c}", special.get(f"PROFILE_{c}", c)))
    plain = [c for c in MENTION_COLUMNS if c not in ("id", "group", "market_trend_risk")]
    plain += [c for cs in OTHER_COLUMNS.values() for c in cs]
    for c in plain:
        cells.append((f"SPECIES_{c}", special.get(f"SPECIES_{c}", c)))
    body = ", ".join(f'{_clean(_trend(e))} AS "{n}"' for n, e in cells)
    part = "CASE WHEN x IN ('Leaves', 'Buds', 'Seedlings') OR contains(x, 'Aerial') THEN 'Aerial part' WHEN x IN ('Flowers', 'Fruits', 'Seeds') THEN 'Reproductive part' WHEN x IN ('Bark', 'Sap') THEN 'Other' WHEN x = 'Whole plant' THEN 'Whole plant' WHEN contains(x, 'Underground') THEN 'Underground part' END"
    flags = ", ".join(
        f"CASE WHEN list_contains(list_transform(harv_parts, lambda x: {part}), '{g}') THEN 'Yes' ELSE 'No' END AS \"SPECIES_harv_parts_{g.replace(' ', '_')}\""
        for g in S.PART_GROUPS
    ) + ", " + ", ".join(
        f"CASE WHEN len(list_filter(uses, lambda x: contains(x, '{u}'))) > 0 THEN 'Yes' ELSE 'No' END AS \"SPECIES_uses_{u}\"" for u in USES
    )
    return f"""
SELECT coalesce(p.id, m.id) AS id, m."group" AS "SPECIES_group", {body}, coalesce(array_to_string(list_transform(risk, lambda r: {_clean("r")}), '|'), '') AS "SPECIES_risk", {flags}
FROM profile_rows p FULL JOIN mention_rows m ON p.id = m.id"""


@query("fact_table", with_views("wide_survey", PROFILE_ROWS + MENTION_ROWS.replace(LONG, "") + _fact_sql()))
def fact_table(spark, sf):
    df = S.fact_table(mention_rows(spark, sf), profile_pipeline(spark, sf), USES)
    return df.withColumn("SPECIES_risk", F.concat_ws("|", "SPECIES_risk"))


def _taxa(spark, sf):
    """Taxon, its code (null: not identified), life form and home zone."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    home = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return home.select(
        F.concat(F.lit("Taxon "), F.col("s_suppkey").cast("string")).alias("taxon"),
        F.when(F.col("s_acctbal") > 3000, F.col("s_suppkey")).alias("code"), F.col("s_nationkey").alias("nation"), F.col("r_name").alias("zone"),
    )


@query("fact_enriched", with_views("wide_survey", PROFILE_ROWS + MENTION_ROWS.replace(LONG, "") + """
, taxa AS (SELECT concat('Taxon ', CAST(s_suppkey AS VARCHAR)) AS taxon, CASE WHEN s_acctbal > 3000 THEN s_suppkey END AS code, r_name AS zone
           FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
, forms AS (SELECT p_partkey AS code, p_type AS life_form FROM part)
, areas AS (SELECT p_partkey AS code, CASE p_size % 3 WHEN 0 THEN 'Isère' WHEN 1 THEN 'Val d Oise' ELSE 'Ile-de-France' END AS dpt, p_retailprice AS range_size FROM part)
SELECT m.id, m."group" AS "SPECIES_group", m.name AS "SPECIES_name", m.dpt AS "SPECIES_dpt", code, zone, life_form, range_size
FROM (SELECT DISTINCT coalesce(p.id, m.id) AS id, m."group", m.name, trim(m.dpt) AS dpt, m.* EXCLUDE (id, "group", name, dpt) FROM profile_rows p FULL JOIN mention_rows m ON p.id = m.id) m
LEFT JOIN taxa ON taxon = m.name LEFT JOIN forms USING (code) LEFT JOIN areas USING (code, dpt) WHERE code IS NOT NULL"""))
def fact_enriched(spark, sf):
    part = table(spark, sf, "part")
    third = F.col("p_size") % 3
    forms = part.select(F.col("p_partkey").alias("code"), F.col("p_type").alias("life_form"))
    areas = part.select(
        F.col("p_partkey").alias("code"), F.when(third == 0, "Isère").when(third == 1, "Val d Oise").otherwise("Ile-de-France").alias("dpt"),
        F.col("p_retailprice").alias("range_size"),
    )
    fact = S.fact_table(mention_rows(spark, sf), S.profile_pipeline(wide_survey(spark, sf)), USES)
    out = S.enriched_facts(
        fact,
        [
            (_taxa(spark, sf).drop("nation"), {"SPECIES_name": "taxon"}), (forms, {"code": "code"}),
            (areas, {"code": "code", "SPECIES_dpt": "dpt"}),
        ],
        identified="code",
    )
    return out.select("id", "SPECIES_group", "SPECIES_name", "SPECIES_dpt", "code", "zone", "life_form", "range_size")


@query("enrichment_coverage", with_views("wide_survey", LONG + FIELDS + CELLS + """
, taxa AS (SELECT concat('Taxon ', CAST(s_suppkey AS VARCHAR)) AS name, CASE WHEN s_acctbal > 3000 THEN s_suppkey END AS code,
    CASE WHEN s_acctbal <= 3000 AND s_nationkey < 12 THEN 'Mushroom' END AS comment FROM supplier)
, j AS (SELECT t.id, code, coalesce(comment = 'Mushroom', FALSE) AS outside FROM tidy t LEFT JOIN taxa USING (name))
SELECT count(*) AS n_mentions, count(*) FILTER (outside) AS n_outside, count(*) FILTER (code IS NULL AND NOT outside) AS n_genus,
       count(DISTINCT id) FILTER (outside) AS ids_outside, count(DISTINCT id) FILTER (code IS NULL AND NOT outside) AS ids_genus,
       count(DISTINCT id) AS ids_all FROM j"""))
def enrichment_coverage(spark, sf):
    supplier = table(spark, sf, "supplier")
    low = F.col("s_acctbal") <= 3000
    taxa = supplier.select(
        F.concat(F.lit("Taxon "), F.col("s_suppkey").cast("string")).alias("name"),
        F.when(~low, F.col("s_suppkey")).alias("code"),
        F.when(low & (F.col("s_nationkey") < 12), "Mushroom").alias("comment"),
    )
    rows = joins.enrich(mention_rows(spark, sf).select("id", "name"), joins.unique_dimension(taxa, ["name"]), ["name"])
    return S.enrichment_coverage(rows, "comment", "code", ("Mushroom", "Alga", "Lichen"))
