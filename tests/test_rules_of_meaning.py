"""Small hand-worked cases, one per rule in which the survey's meaning differs from Spark's default."""

import pytest
from pyspark.sql import functions as F, types as T

from gleanframe.functions import nulls, text
from gleanframe.operators import joins, mentions as M, reshape, rules as R, survey as S
from gleanframe.sources.files import scan_delimited, write_delimited


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


SCHEMA = T.StructType(
    [T.StructField("k", T.IntegerType()), T.StructField("a", T.StringType()), T.StructField("b", T.IntegerType())]
)


def test_blank_and_na_cells(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('k,a,b\n1,x,1\n2,NA,NA\n3,,\n4,"",4\n5,"say ""hi"", ok",5\n')
    assert rows(scan_delimited(spark, str(path), SCHEMA)) == [
        (1, "x", 1), (2, None, None), (3, None, None), (4, None, 4), (5, 'say "hi", ok', 5)
    ]
    kept = scan_delimited(spark, str(path), SCHEMA, blank_as_null=False)
    assert rows(kept) == [(1, "x", 1), (2, None, None), (3, "", None), (4, "", 4), (5, 'say "hi", ok', 5)]
    # complete cases keep blanks, they are not missing
    assert [r[0] for r in rows(kept.select("k", "a").dropna())] == [1, 3, 4, 5]


def test_sink_creates_folders_and_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", None), (2, None, 3)], SCHEMA)
    write_delimited(df, str(tmp_path / "new" / "folder"))
    assert rows(scan_delimited(spark, str(tmp_path / "new" / "folder"), SCHEMA)) == rows(df)


def test_null_keys_match_only_on_request(spark):
    l = spark.createDataFrame([(1, "a"), (None, "b")], "k int, l string")
    r = spark.createDataFrame([(1, "x"), (None, "y")], "k int, r string")
    assert rows(joins.enrich(l, r, ["k"])) == [(1, "a", "x"), (None, "b", None)]
    assert rows(joins.enrich(l, r, ["k"], null_keys="match")) == [(1, "a", "x"), (None, "b", "y")]


@pytest.mark.parametrize("how,want", [
    ("inner", [(1, "a", "x")]),
    ("left", [(1, "a", "x"), (2, "b", None), (None, "c", None)]),
    ("right", [(1, "a", "x"), (3, None, "z"), (None, None, "w")]),
    ("full", [(1, "a", "x"), (2, "b", None), (3, None, "z"), (None, None, "w"), (None, "c", None)]),
])
def test_join_kinds(spark, how, want):
    l = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, l string")
    r = spark.createDataFrame([(1, "x"), (3, "z"), (None, "w")], "k int, r string")
    key = lambda t: tuple((x is None, str(x)) for x in t)
    assert rows(joins.enrich(l, r, ["k"], how=how)) == sorted(want, key=key)


def test_membership_is_never_null(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    assert rows(df.filter(~nulls.in_set("x", [1]))) == [(5,), (None,)]


def test_strict_sum(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 3)], "g string, x int")
    assert rows(df.groupBy("g").agg(nulls.strict_sum("x"))) == [("a", None), ("b", 5)]


def test_unknown_condition_stays_unknown(spark):
    df = spark.createDataFrame([("Yes",), ("No",), (None,)], "x string")
    got = df.select("x", nulls.if_else(F.col("x") == "Yes", "harvester", "Non-harvester"))
    assert rows(got) == [("No", "Non-harvester"), ("Yes", "harvester"), (None, None)]


def test_rounding_and_empty_ratio(spark):
    assert one(spark, nulls.half_even(F.lit(0.125), 2)) == 0.12
    assert one(spark, nulls.half_even(F.lit(2.5))) == 2
    assert one(spark, nulls.ratio(F.lit(0), F.lit(0))) is None


def test_closed_sets_and_letters(spark):
    df = spark.createDataFrame([("b",), ("a",), ("zz",), (None,)], "x string")
    levels = ["a", "b"]
    got = df.select("x", nulls.closed_set("x", levels), nulls.level_ordinal("x", levels), nulls.level_letter("x", levels))
    assert rows(got) == [("a", "a", 1, "A"), ("b", "b", 2, "B"), ("zz", None, None, None), (None, None, None, None)]


def test_recode_keeps_or_drops_unknown(spark):
    df = spark.createDataFrame([("Yes",), ("IDK",)], "x string")
    m = {"Yes": "Trend"}
    assert rows(df.select(nulls.recode("x", m))) == [("IDK",), ("Trend",)]
    assert rows(df.select(nulls.recode("x", m, unknown="null"))) == [("Trend",), (None,)]


def test_first_match_and_greedy_brackets(spark):
    assert one(spark, text.replace_first(F.lit("a-b-c"), "-", "+")) == "a+b-c"
    assert one(spark, text.remove_parenthesis(F.lit("Office (a) and (b) end"), trim=False)) == "Office  end"
    assert one(spark, text.remove_parenthesis(F.lit("State agency (national)"), trim=False)) == "State agency "
    assert one(spark, S.clean_answer(F.lit("I don't know (really)"))) == "IDK"
    assert one(spark, text.extract(F.lit("abc"), r"\d+")) is None
    assert one(spark, text.sentence_case(F.lit("wHOLE Plant"))) == "Whole plant"
    assert one(spark, text.squeeze(F.lit("a___b_c"))) == "a_b_c"
    assert one(spark, text.remove_code(F.lit("Haute-Corse (2B)"))) == "Haute-Corse"


def test_place_names_meet_after_normalising(spark):
    assert one(spark, text.normalise_name(F.lit("Côte-d'Or"))) == "Cote d Or"
    assert one(spark, text.normalise_name(F.lit("Isère œuvre Ægir"))) == "Isere oeuvre AEgir"
    assert one(spark, text.fuse_places(F.lit("Val-d'Oise"))) == "Ile-de-France"
    assert one(spark, text.fuse_places(F.lit("Isère"))) == "Isère"


def test_dimension_duplicates_drop_and_conflicts_fail(spark):
    dim = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    assert rows(joins.unique_dimension(dim, ["k"])) == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="two values"):
        joins.unique_dimension(dim.union(spark.createDataFrame([(2, "c")], dim.schema)), ["k"]).collect()


def test_group_filter_is_per_group(spark):
    df = spark.createDataFrame(
        [("a", "d1", "rule"), ("a", "d2", None), ("b", "d1", None), (None, "d1", None), (None, "d2", "rule")],
        "name string, place string, r string",
    )
    # a loses its unmatched row, b has no match and stays whole; null is a group too
    assert rows(joins.keep_matched_if_any(df, ["name"], F.col("r").isNotNull())) == [
        ("a", "d1", "rule"), ("b", "d1", None), (None, "d2", "rule")
    ]


def test_propagate_any(spark):
    df = spark.createDataFrame([(1, "u", None), (1, "s", "No"), (2, "s", "No")], "id int, a string, known string")
    assert rows(joins.propagate_any(df, ["id"], F.col("a") == "u", "known", "Yes")) == [
        (1, "s", "Yes"), (1, "u", "Yes"), (2, "s", "No")
    ]


def test_parallel_unnest_repeats_single_cells(spark):
    df = spark.createDataFrame([(1, ["x"], ["p", "q"], None), (2, ["y"], None, None)], "id int, a array<string>, b array<string>, c array<string>")
    assert rows(reshape.unnest_parallel(df, ["a", "b", "c"])) == [
        (1, "x", "p", None), (1, "x", "q", None), (2, "y", None, None)
    ]


def test_unpivot_then_widen_is_identity(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "c")], "id int, x string, y string")
    long = reshape.to_long(df, ["id"], ["x", "y"]).withColumn("o", F.lit(0))
    assert rows(reshape.widen_first(long, ["id"], "column_name", "value", "o", ["x", "y"])) == rows(df)


def test_flags_fill(spark):
    df = spark.createDataFrame([(1, "Leaves"), (1, None), (2, None)], "id int, part string")
    assert rows(reshape.presence_flags(df, ["id"], "part", ["Leaves"], "p_", fill="Non")) == [(1, "Yes"), (2, "Non")]


def test_coalesce_rows_takes_first_known(spark):
    df = spark.createDataFrame([(1, 3, None, "b"), (1, 4, "a", "c")], "id int, o int, x string, y string")
    assert rows(reshape.coalesce_rows(df, ["id"], "o")) == [(1, "a", "b")]


def test_empty_columns_go(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None)], "id int, x string, y string")
    assert reshape.drop_empty_columns(df, ["x", "y"]).columns == ["id", "y"]


COLS = {
    "id": [1, 2, 3],
    "GsuppQsupp____Known": ["No", "No", None],
    "G3Q00001____Name": ["Arnica, Gentian,Arnica", " ", "Arnica"],
    "G3Q00002____Dpt": ["Val-d'Oise (95)", "Isère (38)", "Côte-d'Or (21)"],
    "G3Q00006_SQ001____Leaves": ["Yes", "Yes", "No"],
    "G3Q00006_SQ002____Whole_plant": ["Yes", "No", "No"],
    "G3Q00018_SQ001____Trend": ["Yes", "No", None],
    "G3Q00018_SQ002____Trend_b": ["No", None, None],
    "G3Q00008_SQ001____Alone": ["x", None, None],
    "G3Q00008__other__Other": [None, None, "by boat"],
    "G4Q00001____Name": [None, "Gentian", None],
    "G6Q00001____Name": ["Yarrow", None, "Sage"],
    "G6Q00002____Sustainable": ["No", "Yes", "Yes"],
    "G6Q00010_SQ001____Alone": ["y", None, "z"],
}


@pytest.fixture(scope="module")
def export(spark):
    data = list(zip(*COLS.values()))
    return spark.createDataFrame(data, "id int, " + ", ".join(f"`{c}` string" for c in list(COLS)[1:]))


def test_catalogue_reads_the_grammar():
    q = {x.column: x for x in S.catalogue(["G3Q00006_SQ001____Dried_leaves", "G10Q00010_SQ002____X", "id", "G3Q00008__other__Other"])}
    assert (q["G3Q00006_SQ001____Dried_leaves"].group, q["G3Q00006_SQ001____Dried_leaves"].qcode) == (3, 6)
    assert (q["G10Q00010_SQ002____X"].group, q["G10Q00010_SQ002____X"].qcode) == (10, 10)
    assert q["G3Q00008__other__Other"].other and "id" not in q


def test_mention_pipeline(export):
    got = S.mention_pipeline(export, (3, 4, 6), known="GsuppQsupp____Known").select(
        "id", "group", "name", "sustainability", "known_unsustainable", "dpt", "market_trend", "harv_parts", "harv_type_Alone", "harv_type_other"
    )
    table = {(r.id, r.group, r.name, r.market_trend): r for r in got.collect()}
    # two species, two trend answers; the doubled name counts once; blank names give no row
    assert sorted(table, key=str) == sorted(
        [(1, 3, "Arnica", "Yes"), (1, 3, "Arnica", "No"), (1, 3, "Gentian", "Yes"), (1, 3, "Gentian", "No"),
         (1, 6, "Yarrow", None), (2, 4, "Gentian", None), (3, 3, "Arnica", None), (3, 6, "Sage", None)], key=str)
    r = table[(1, 3, "Arnica", "Yes")]
    assert r.dpt == "Ile de France" and r.harv_parts == ["Leaves", "Whole plant"] and r.harv_type_Alone == "x"
    # an unsustainable further species corrects the answer given before
    assert r.known_unsustainable == "Yes" and table[(1, 6, "Yarrow", None)].sustainability == "Unsustainable"
    assert table[(2, 4, "Gentian", None)].known_unsustainable == "Yes"
    assert table[(3, 3, "Arnica", None)].known_unsustainable is None
    assert table[(3, 3, "Arnica", None)].harv_parts == [] and table[(3, 3, "Arnica", None)].dpt == "Côte d Or"


def test_other_text_keeps_groups_apart_unless_legacy(export):
    args = (S.catalogue(export.columns), S.CHOICE_OTHER_FIELDS["harv_type"], (3, 4, 6), "harv_type")
    assert rows(S.multichoice_other(export, *args)) == [
        (1, 3, "x", None), (1, 6, "y", None), (3, 3, None, "by boat"), (3, 6, "z", None)
    ]
    assert rows(S.multichoice_other(export, *args, legacy=True)) == [(1, 3, "x", None), (3, 3, "z", "by boat")]


def test_fan_out_multiplies_and_counts_can_ignore_it(spark):
    df = spark.createDataFrame([(1, "n", "Unsustainable", ["a", "b"], ["u", "v"], [])], "id int, name string, answer string, p array<string>, q array<string>, r array<string>")
    fan = S.fan_out(df, ["p", "q", "r"])
    assert fan.count() == 4
    assert M.unsustainable_percent(fan).first().unsustainable == 1
    assert M.unsustainable_percent(fan, count_mode="rows").first().unsustainable == 4


def test_half_is_not_above_half(spark):
    df = spark.createDataFrame([("a", 50.0), ("b", 50.01)], "name string, ratio double")
    assert M.share_above(df).first().percent_above == 50.0


RULE_SCHEMA = "name string, level string, place string, status_label string, grouping string, status_code string"


def test_rule_levels_statuses_and_scores(spark):
    rules = spark.createDataFrame(
        [
            ("a", "Département", "d1", "Protection départementale", "Protection", "P"),
            ("b", "État", "France", "Réglementation", "Other", "REGL"),
            ("c", "Région", "r1", "Odd label", "Protection", "P"),
            ("d", "État", "France", "Liste rouge", "Red list", "LR"),
        ],
        RULE_SCHEMA,
    )
    answers = spark.createDataFrame(
        [(1, "a", "d1", "r1", "Yes, regulated"), (2, "a", "d2", "r1", "No"), (3, "b", "d2", "r2", "no idea, NO"),
         (4, "c", "d1", "r1", "Yes"), (5, "d", "d1", "r1", "No rule"), (6, "d", "d1", "r1", None), (7, "d", "d1", "r1", "IDK")],
        "id int, name string, area string, zone string, regulation string",
    )
    got = R.score_answers(R.answers_with_status(answers, rules, {"department": "area", "region": "zone", "national": None}))
    assert rows(got.select("id", "regulation", "status_group", "verdict")) == [
        (1, "Yes", "Department-level protection", "Correct"),
        # id 2: the species has a rule elsewhere, so its unmatched row is dropped
        (3, "No", "Regulation", "Incorrect"),
        (4, "Yes", None, "Incorrect"),  # a label outside the list is never right
        (5, "No", "No regulation/protection", "Correct"),
        (7, "IDK", "No regulation/protection", "Incorrect"),
    ]


def test_area_without_mentions_stays_null_in_the_layer(spark):
    geo = spark.createDataFrame([("x",), ("y",)], "area string")
    cells = spark.createDataFrame([("x", "n", 1, 1, 2)], "area string, name string, sustainable int, unsustainable int, total_citations int")
    got = {r.area: (r.prop_unsustainable, r.step, r.global_max) for r in M.map_layer(geo, cells, ["area"], name="n").collect()}
    assert got == {"x": (50.0, 3, 2), "y": (None, None, 2)}
