"""Cases that the stand-in tables never produce: accents, undeclared values, several answers, several rows."""

import math

import pytest
from pyspark.sql import functions as F, types as T

from gleanframe.operators import joins, mentions as M, ranks, rules as R, survey as S
from gleanframe.session import scratch_path
from gleanframe.sources.files import scan_delimited, write_delimited, zoned_timestamp

PLACES = {"department": "area", "region": "zone", "national": None}


def test_places_match_whatever_their_spelling(spark):
    rules = spark.createDataFrame(
        [("A", "Département", "Isère", "Protection départementale", "Protection", "PD", "text 1"),
         ("A", "Département", "Isère", "Protection départementale", "Protection", "PD", "text 2"),
         ("B", "Département", "Val-d'Oise", "Réglementation", "Réglementation", "REGL", "text 3")],
        "name string, level string, place string, status_label string, grouping string, status_code string, citation string",
    )
    answers = spark.createDataFrame([(1, "A", "Isere", "z", "Yes"), (2, "B", "Val d Oise", "z", "No")], "id int, name string, area string, zone string, regulation string")
    got = {r.name: r.status_group for r in R.answers_with_status(answers, rules, PLACES).collect()}
    assert got == {"A": "Department-level protection", "B": "Regulation"}
    # with the citation as identity, each text of one status counts
    both = R.answers_with_status(answers, rules, PLACES, identity=["citation"]).groupBy("name").count().collect()
    assert {r["name"]: r["count"] for r in both} == {"A": 2, "B": 1}


def test_undeclared_categories_stay_in_the_total(spark):
    df = spark.createDataFrame([("g", v) for v in "xyz"] + [("g", None)], "g string, v string")
    row = M.contingency_percent(df, "g", "v", ["x", "y"]).first()
    assert (row.x, row.y, row.undeclared) == (33.3, 33.3, 1)


def test_frequencies_of_many_categories(spread):
    df = spread.range(30_000).select(F.col("id"), F.concat(F.lit("c"), (F.col("id") % 15_000).cast("string")).alias("c"))
    got = M.frequencies(df, "c")
    assert got.count() == 15_000 and got.agg(F.max("position")).first()[0] == 15_000
    assert M.frequencies(spread.createDataFrame([(1, None), (2, "a")], "id int, c string"), "c", missing=None).collect()[0].category == "a"


def test_density_is_never_negative(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (0, 1, 2, 50, 90)], "g string, v double")
    for bounds in ((None, None), (1.0, 60.0)):
        rows = M.density(df, "g", "v", *bounds, points=16).collect()
        assert len(rows) == 16 and all(r.density >= 0 for r in rows)
        assert {r.n_outside for r in rows} == ({0} if bounds[0] is None else {2})


def test_known_unsustainable_goes_over_all_rows_of_a_respondent(spark):
    columns = ["id", "G3Q00001____Name", "G4Q00001____Name"]
    wide = spark.createDataFrame([(1, "Arnica", None), (1, None, "Gentian"), (2, "Arnica", None)], "id int, " + ", ".join(f"`{c}` string" for c in columns[1:]))
    got = {(r.id, r.name): r.known_unsustainable for r in S.mention_pipeline(wide, (3, 4)).collect()}
    assert got == {(1, "Arnica"): "Yes", (1, "Gentian"): "Yes", (2, "Arnica"): None}


def test_profile_keeps_every_answer(spark):
    a, b, c = "G21Q00009_SQ001____For", "G21Q00009_SQ002____Income", "G21Q00001____Gender"
    wide = spark.createDataFrame([(1, "For leisure", "A main income", "f"), (2, None, "A main income", None), (3, None, None, None)], f"id int, `{a}` string, `{b}` string, `{c}` string")
    got = sorted((r.id, r.harvester_status, r.gender) for r in S.profile_pipeline(wide).select("id", "harvester_status", "gender").collect())
    assert got == [(1, "A main income", "f"), (1, "For leisure", "f"), (2, "A main income", None)]


def test_dimension_check_survives_pruning(spark):
    dim = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(Exception, match="dimension key"):
        joins.unique_dimension(dim, ["k"]).select("k").collect()


def test_quoted_line_breaks_and_malformed_rows(spark):
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.StringType())])
    path = scratch_path(spark, "breaks")
    write_delimited(spark.createDataFrame([(1, "a\nb"), (2, 'say "x",\nthen')], schema), path)
    for blank in (True, False):
        assert sorted(map(tuple, scan_delimited(spark, path, schema, blank_as_null=blank).collect())) == [(1, "a\nb"), (2, 'say "x",\nthen')]
    bad = scratch_path(spark, "malformed")
    spark.createDataFrame([("k,v",), ("one,x",)], "value string").coalesce(1).write.text(bad)
    for blank in (True, False):
        with pytest.raises(Exception):
            scan_delimited(spark, bad, schema, blank_as_null=blank).collect()


def test_local_times_with_zone(spark):
    df = spark.createDataFrame([("2021-07-01 12:00:00",), ("2021-12-01 12:00:00",), ("soon",)], "t string")
    got = [r[0] for r in df.select(F.date_format(zoned_timestamp("t", "Europe/Paris"), "HH:mm")).collect()]
    assert got == ["10:00", "11:00", None]


def test_affiliations_and_answer_shares(spark):
    df = spark.createDataFrame([("Yes",), ("Yes",), ("No",), (None,)], "regulation string")
    assert {r.regulation: (r.n, r.pct) for r in R.answer_shares(df).collect()} == {"Yes": (2, 50.0), "No": (1, 25.0), None: (1, 25.0)}


def test_pairs_of_many_groups(spread):
    df = spread.range(2400).select((F.col("id") % 600).alias("g"), F.col("id").cast("double").alias("v"))
    pairs = ranks.dunn_pairs(df, "g", "v")
    assert pairs.count() == 600 * 599 // 2
    assert not math.isnan(pairs.agg(F.max("p_adj")).first()[0])


def test_leading_axes_are_those_of_the_whole_matrix(spread):
    from gleanframe.operators import factor as X

    i = F.col("id")
    # a and b mostly agree, c halves them: inertias well apart
    df = spread.range(3000).select(
        (i % 4).cast("string").alias("a"), F.when(i % 11 < 9, i % 4).otherwise((i + 1) % 4).cast("string").alias("b"),
        F.when(i % 13 < 9, i % 4 < 2).otherwise(i % 4 >= 2).cast("string").alias("c"),
    )
    profiles = X.profile_counts(df, ["a", "b", "c"])
    model = X.fit_mca(profiles, ["a", "b", "c"])
    vectors, values, settled = X.leading_axes(profiles, ["a", "b", "c"], axes=2)
    assert settled and abs(values - model.eigenvalues[:2]).max() < 1e-6
    at = {k: i for i, k in enumerate(model.categories)}
    dots = [sum(r[f"v_{k + 1}"] * model.vectors[at[(r["var"], r["cat"])], k] for r in vectors.collect()) for k in range(2)]
    assert all(abs(abs(d) - 1) < 1e-3 for d in dots)


def test_leading_axes_of_many_categories(spread):
    from gleanframe.operators import factor as X

    df = spread.range(20_000).select((F.col("id") % 5000).cast("string").alias("a"), (F.col("id") % 5000 % 3).cast("string").alias("b"))
    _, values, settled = X.leading_axes(X.profile_counts(df, ["a", "b"]), ["a", "b"], axes=1)
    # b is a function of a: two axes of inertia one
    assert settled and abs(values[0] - 1) < 1e-6
