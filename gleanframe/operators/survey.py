"""Questionnaire exports: column names are parsed once, rows are reshaped in place.

In an export one row holds everything a respondent said, so the tidy mention table
is a narrow transformation: each row is repeated per question group, every field takes
its group's column, and neither unpivot nor pivot is needed. The long-table operators
(``answers_long`` and the functions of ``reshape``) remain for data that arrives long.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gleanframe.functions import text
from gleanframe.functions.nulls import if_else, in_set, recode, recode_pattern
from gleanframe.operators import reshape
from gleanframe.operators.joins import enrich, prefix_columns, spread_group_value, unique_dimension
from gleanframe.session import dealt, materialise

# Question numbers per field, in the first two species groups and in the
# further ones.
FIRST_GROUPS = (3, 4)
SINGLE_FIELDS = {
    "name": (1, 1),
    "dpt": (2, 4),
    "presence": (4, 6),
    "harv_spread": (5, 7),
    "start_obs": (10, 12),
    "state_resource": (11, 13),
    "harv_variation": (12, 14),
    "harv_intensity": (13, 15),
    "market_trend": (18, 20),
    "market_trend_risk": (19, 21),
    "species_regulation": (20, 22),
    "regulation_adapted": (21, 23),
}
CHOICE_FIELDS = {"harv_parts": (6, 8), "uses": (7, 9), "risk": (17, 19)}
CHOICE_OTHER_FIELDS = {"harv_type": (8, 10), "company_type": (9, 11), "unadapted_regulation_cause": (22, 24)}
SUSTAINABLE_QUESTION = 2
PROFILE_GROUP = 21
PROFILE_FIELDS = {
    "gender": 1, "age": 2, "evt_studies": 4, "harvester": 6, "harvesting_start": 7, "nb_harv_species": 8,
    "harvester_status": 9, "harvester_status_company": 10, "harv_group": 11, "name_harv_group": 12,
    "name_affiliated_organisation": 14, "job_in_affiliated_organisation": 15,
    "size_affiliated_organisation": 16, "nb_species_affiliated_organisation": 17,
}
PROFILE_CHOICE_FIELDS = {"education_level": 3, "socio_pro_category": 5, "affiliated_organisation_type": 13}

QUESTION = re.compile(r"^G(\d+)Q0{3,4}(\d+)_")


@dataclass(frozen=True)
class Question:
    """One export column, as its name describes it."""

    column: str
    group: int
    qcode: int
    label: str
    option: bool
    other: bool


def catalogue(columns: Iterable[str]) -> list[Question]:
    """Parse the column names that follow the question-code grammar."""
    out = []
    for c in columns:
        m = QUESTION.match(c)
        if m:
            label = c.rsplit("____", 1)[-1] if "____" in c else c[m.end():]
            out.append(Question(c, int(m[1]), int(m[2]), label, "_SQ" in c, "Other" in c))
    return out


def pick(questions: Sequence[Question], group: int, qcode: int) -> list[Question]:
    return [q for q in questions if q.group == group and q.qcode == qcode]


def question_number(numbers: tuple[int, int], group: int) -> int:
    return numbers[0] if group in FIRST_GROUPS else numbers[1]


def answers_long(df: DataFrame, questions: Sequence[Question], id: str = "id") -> DataFrame:
    """(id, group, qcode, ordinal, value) for the chosen questions, nulls dropped.

    Only the chosen columns are read; the keys come from the parsed names.
    """
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(q.group).alias("group"), F.lit(q.qcode).alias("qcode"), F.lit(i).alias("ordinal"),
                    F.col(f"`{q.column}`").cast("string").alias("value"),
                )
                for i, q in enumerate(questions)
            ]
        )
    )
    return df.select(F.col(id).alias("id"), cells.alias("c")).select("id", "c.*").filter(F.col("value").isNotNull())


def field_cells(questions: Sequence[Question], fields: dict[str, tuple[int, int]], groups: Sequence[int]) -> list[tuple[str, Question]]:
    """(field, question) pairs of the given fields over the given groups."""
    return [
        (name, q)
        for g in groups
        for name, numbers in fields.items()
        for q in pick(questions, g, question_number(numbers, g))
    ]


def multichoice(
    df: DataFrame, questions: Sequence[Question], numbers: tuple[int, int], groups: Sequence[int], field: str, id: str = "id"
) -> DataFrame:
    """One row per ticked option: (id, group, label)."""
    cells = field_cells(questions, {field: numbers}, groups)
    ticked = F.explode(
        F.array_compact(
            F.array(
                *[
                    F.when(
                        F.col(f"`{q.column}`") == "Yes",
                        F.struct(F.lit(q.group).alias("group"), F.lit(nice_label(q)).alias(field)),
                    )
                    for _, q in cells
                ]
            )
        )
    )
    return df.select(F.col(id).alias("id"), ticked.alias("t")).select("id", "t.*")


def nice_label(q: Question) -> str:
    return q.label.replace("_", " ").capitalize()


def option_column(field: str, q: Question) -> str:
    """Stable column name of an option of a question with free text."""
    name = f"{field}_other" if q.other else field
    if q.option:
        name = f"{name}_{q.label}"
    return re.sub(r"_{2,}", "_", name)


def multichoice_other(
    df: DataFrame,
    questions: Sequence[Question],
    numbers: tuple[int, int],
    groups: Sequence[int],
    field: str,
    id: str = "id",
    legacy: bool = False,
) -> DataFrame:
    """One column per option (and free text), one row per (id, group) with any answer.

    ``legacy=True`` keeps one row per id: the first group, with each column filled
    from the first group that has it.
    """
    names = list(dict.fromkeys(option_column(field, q) for _, q in field_cells(questions, {field: numbers}, groups)))
    structs = []
    for g in groups:
        cols = {option_column(field, q): q.column for _, q in field_cells(questions, {field: numbers}, [g])}
        cells = [F.col(f"`{cols[n]}`") if n in cols else F.lit(None).cast("string") for n in names]
        structs.append(
            F.when(
                F.coalesce(*cells).isNotNull(),
                F.struct(F.lit(g).alias("group"), *[c.alias(n) for c, n in zip(cells, names)]),
            )
        )
    rows = F.array_compact(F.array(*structs))
    if not legacy:
        return df.select(F.col(id).alias("id"), F.explode(rows).alias("r")).select("id", "r.*")
    held = df.select(F.col(id).alias("id"), rows.alias("rows")).filter(F.size("rows") > 0)

    def first_of(n: str) -> Column:
        found = F.filter(F.transform("rows", lambda r: r[n]), lambda v: v.isNotNull())
        return F.get(found, F.lit(0)).alias(n)

    return held.select("id", F.get("rows", F.lit(0))["group"].alias("group"), *[first_of(n) for n in names])


def sustainability_flag(long: DataFrame) -> DataFrame:
    """Add the declared sustainability of each (id, group) to a long answer table."""
    said = F.min_by(
        F.when(F.col("qcode") == SUSTAINABLE_QUESTION, F.col("value")),
        F.when(F.col("qcode") == SUSTAINABLE_QUESTION, F.col("ordinal")),
    )
    flagged = spread_group_value(long, ["id", "group"], __said=said)
    return flagged.withColumn("sustainability", _sustainability(F.col("group"), F.col("__said"))).drop("__said")


def _sustainability(group: Column, said: Column) -> Column:
    return (
        F.when(group == 3, "Sustainable")
        .when(group == 4, "Unsustainable")
        .when(said == "Yes", "Sustainable")
        .otherwise("Unsustainable")
    )


def mention_pipeline(df: DataFrame, groups: Sequence[int], id: str = "id", known: str | None = None) -> DataFrame:
    """Wide export to one row per (respondent, group, species), multi-choice answers as arrays.

    The work is narrow: the row is repeated per group, rows without a species go, and every
    field picks its group's column. Only a mention called unsustainable in one export row is
    carried to the respondent's other rows, by a join on the ids that have both; without such ids there is none. A question
    asked by one column is a plain cell; only questions spread over several columns become
    lists, which run in parallel (a single answer repeats). Option columns of the free-text
    questions follow as plain columns.
    """
    questions = catalogue(df.columns)
    null = F.lit(None).cast("string")
    group = F.col("__group")

    def of_group(cells: dict[int, Column]) -> Column:
        out = None
        for g, c in cells.items():
            out = F.when(group == g, c) if out is None else out.when(group == g, c)
        return null if out is None else out

    def asked(g: int, numbers: tuple[int, int]) -> list[Column]:
        return [F.col(f"`{q.column}`") for q in pick(questions, g, question_number(numbers, g))]

    names = {g: F.trim(F.concat_ws(",", *asked(g, SINGLE_FIELDS["name"]))) for g in groups}
    said = {g: [F.col(f"`{q.column}`") for q in pick(questions, g, SUSTAINABLE_QUESTION)] for g in groups}
    flags = {
        g: _sustainability(F.lit(g), F.coalesce(*said[g]) if said[g] and g not in FIRST_GROUPS else null) for g in groups
    }
    bad = F.lit(False)
    for g in groups:
        bad = bad | (_has_name(names[g]) & (flags[g] == "Unsustainable"))
    known_col = F.col(f"`{known}`") if known else null
    rows = df.select(
        "*", F.when(bad, "Yes").otherwise(known_col).alias("__known"), F.explode(F.array(*map(F.lit, groups))).alias("__group")
    ).filter(_has_name(of_group(names)))

    out = {
        "id": F.col(id), "group": group, "known_unsustainable": F.col("__known"), "sustainability": of_group(flags),
        "name": of_group(names),
    }
    lists = {}
    for f, numbers in SINGLE_FIELDS.items():
        if f == "name":
            continue
        found = {g: asked(g, numbers) for g in groups}
        width = max(map(len, found.values()))
        columns = [of_group({g: c[i] for g, c in found.items() if i < len(c)}) for i in range(width)]
        if f == "dpt":
            columns = [F.translate(text.fuse_places(text.remove_code(c)), "-'", "  ") for c in columns]
        if width > 1:
            lists[f] = width
            out[f] = F.filter(F.array(*columns), lambda v: v.isNotNull())
        else:
            out[f] = columns[0] if columns else null
    for f, numbers in CHOICE_FIELDS.items():
        options: dict[str, dict[int, Column]] = {}
        for _, q in field_cells(questions, {f: numbers}, groups):
            options.setdefault(nice_label(q), {})[q.group] = F.col(f"`{q.column}`")
        ticks = [F.when(of_group(cells) == "Yes", F.lit(label)) for label, cells in options.items()]
        out[f] = F.array_except(F.array(null, *ticks), F.array(null))
    for f, numbers in CHOICE_OTHER_FIELDS.items():
        columns_of: dict[str, dict[int, Column]] = {}
        for _, q in field_cells(questions, {f: numbers}, groups):
            columns_of.setdefault(option_column(f, q), {})[q.group] = F.col(f"`{q.column}`")
        out |= {c: of_group(cells) for c, cells in columns_of.items()}

    tidy = rows.select(*[c.alias(n) for n, c in out.items()])
    species = F.explode(F.array_distinct(F.split("name", r"\s*,\s*"))).alias("name")
    tidy = tidy.select(*[species if c == "name" else F.col(c) for c in out]).filter(F.col("name") != "")
    out_rows = unnest_parallel(tidy, lists)
    # an only row of its respondent says it itself, so nothing but respondents with more rows meets the wide ones
    per_id = df.select(F.col(id).alias("__id"), bad.alias("__bad")).filter("__id IS NOT NULL").groupBy("__id")
    more = materialise(per_id.agg(F.count(F.lit(1)).alias("__n"), F.bool_or("__bad").alias("__bad")).filter("__n > 1 AND __bad").drop("__n"))
    if more.isEmpty():
        return out_rows
    rows_in = df.count() * len(groups)
    carried = enrich(dealt(out_rows, rows_in, "id"), dealt(more, rows_in, "__id"), {"id": "__id"})
    return carried.withColumn("known_unsustainable", F.when(F.col("__bad"), "Yes").otherwise(F.col("known_unsustainable"))).drop("__bad")


def unnest_parallel(df: DataFrame, lists: dict[str, int]) -> DataFrame:
    """Array columns (with their greatest sizes) to rows, side by side; a single answer repeats.

    A row without any answer keeps one row of nulls; equal rows of one source row count once.
    """
    if not lists:
        return df
    longest = F.array_max(F.array(F.lit(1), *[F.size(f) for f in lists]))
    steps = [
        F.when(
            F.lit(i) < longest,
            F.struct(*[F.get(f, F.when(F.size(f) == 1, 0).otherwise(i)).alias(f) for f in lists]),
        )
        for i in range(max(lists.values()))
    ]
    stepped = df.select("*", F.explode(F.array_distinct(F.array(*steps))).alias("z")).filter(F.col("z").isNotNull())
    return stepped.select(*[F.col(f"z.{c}").alias(c) if c in lists else F.col(c) for c in df.columns])


def _has_name(name: Column) -> Column:
    """Whether a comma-separated cell names anything."""
    return F.translate(name, ", ", "") != ""


def fan_out(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per combination of the array answers; an empty answer gives null."""
    out = df
    for f in fields:
        out = out.select(*[F.explode_outer(F.col(f)).alias(f) if c == f else F.col(c) for c in out.columns])
    return out


def profile_pipeline(df: DataFrame, id: str = "id") -> DataFrame:
    """Wide export to the profile of every respondent with any profile answer.

    One row per respondent, or, where a question of several columns got several answers, one
    for each, the answers of such questions side by side.
    """
    questions = catalogue(df.columns)
    cells, lists, given = {}, {}, []
    for f, q in PROFILE_FIELDS.items():
        found = [F.col(f"`{x.column}`").cast("string") for x in pick(questions, PROFILE_GROUP, q)]
        given += found
        if len(found) > 1:
            lists[f] = len(found)
            cells[f] = F.filter(F.array(*found), lambda v: v.isNotNull())
        else:
            cells[f] = found[0] if found else F.lit(None).cast("string")
    for f, q in PROFILE_CHOICE_FIELDS.items():
        for x in pick(questions, PROFILE_GROUP, q):
            cells[option_column(f, x)] = F.col(f"`{x.column}`").cast("string")
    filled = F.coalesce(F.lit(None).cast("string"), *given).isNotNull()
    return unnest_parallel(df.filter(filled).select(F.col(id).alias("id"), *[c.alias(n) for n, c in cells.items()]), lists)


# Answer texts and the labels they are grouped under.
USE_RULES = tuple((v, v) for v in ("Food", "Cosmetics", "Craft", "Ornamental", "Medical"))
PART_RULES = (("Aerial", "Aerial part"), ("Underground", "Underground part"))
TREND_RULES = (("variable", "Variable"), ("stable", "Stable"), ("decrease", "Decrease"), ("increase", "Increase"))
STATUS_RULES = (("leisure", "Recreational"), ("income", "Professional"))
PART_GROUPS = {
    "Aerial part": ("Leaves", "Buds", "Aerial part", "Seedlings"),
    "Reproductive part": ("Flowers", "Fruits", "Seeds"),
    "Other": ("Bark", "Sap"),
    "Whole plant": ("Whole plant",),
    "Underground part": ("Underground part",),
}
AFFILIATION_RULES = (("No affiliated organisation", "None"), ("wild plants", "Wild-plant business"))
MARKET_TREND = {"Yes": "Trend", "No": "No trend"}
MARKET_TREND_RISK = {"Yes": "Trend with risk", "No": "Trend without risk"}


AFFILIATION = "PROFILE_affiliated_organisation_type"


def part_group(x: Column) -> Column:
    out = None
    for label, members in PART_GROUPS.items():
        hit = x.isin(list(members))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def clean_answer(x: Column, trim: bool = True) -> Column:
    """Unify "don't know" and drop bracketed explanations.

    The patterns run only on values that hold them: most answers are short labels.
    """
    unknown = "I don't know"
    out = F.when(x.contains(unknown), text.replace_first(x, unknown, "IDK")).otherwise(x)
    out = F.when(out.contains("("), text.remove_parenthesis(out, trim=False)).otherwise(out)
    return F.trim(out) if trim else out


def fact_table(mentions: DataFrame, profiles: DataFrame, uses: Sequence[str], trim: bool = True) -> DataFrame:
    """Mentions and profiles joined on id, recoded, with parts and uses as Yes/No flags.

    The multi-choice answers are arrays, so the flags are array tests on the row: no
    fan-out and no widening shuffle.
    """
    m = prefix_columns(mentions, "SPECIES_", ["id"])
    p = prefix_columns(profiles, "PROFILE_", ["id"])
    # both sides have a row per respondent and species at most, so no id is hot
    df = m.join(p, "id", "full_outer")
    parts = F.transform("SPECIES_harv_parts", lambda v: part_group(clean_answer(recode_pattern(v, PART_RULES), trim)))
    used = F.transform("SPECIES_uses", lambda v: clean_answer(recode_pattern(v, USE_RULES), trim))
    arrays = {"SPECIES_harv_parts", "SPECIES_uses", "SPECIES_risk"}
    plain = [c for c in df.columns if c not in arrays and c not in ("id", "SPECIES_group")]
    recoded = {
        "SPECIES_market_trend": recode("SPECIES_market_trend", MARKET_TREND),
        "SPECIES_market_trend_risk": recode("SPECIES_market_trend_risk", MARKET_TREND_RISK),
        "PROFILE_harvester_status": recode_pattern("PROFILE_harvester_status", STATUS_RULES),
        "PROFILE_nb_harv_species": F.coalesce("PROFILE_nb_harv_species", F.lit("0")),
    }
    df = df.select(
        "id", "SPECIES_group",
        *[recode_pattern(recoded.get(c, F.col(c)), TREND_RULES).alias(c) for c in plain],
        parts.alias("__parts"), used.alias("__uses"), F.transform("SPECIES_risk", lambda v: clean_answer(v, trim)).alias("SPECIES_risk"),
    )
    df = df.withColumns(
        {
            "SPECIES_market_trend": if_else(
                F.col("SPECIES_market_trend") == "Trend", F.col("SPECIES_market_trend_risk"), F.col("SPECIES_market_trend")
            ),
            "PROFILE_harvester_status": if_else(
                F.col("PROFILE_harvester") == "Yes", F.col("PROFILE_harvester_status"), F.lit("Non-harvester")
            ),
        }
    ).drop("SPECIES_market_trend_risk", "PROFILE_harvester")
    df = reshape.across(df, [c for c in plain if c in df.columns], lambda c: clean_answer(c, trim))
    if AFFILIATION in df.columns:
        df = df.withColumn(AFFILIATION, recode_pattern(AFFILIATION, AFFILIATION_RULES))
    has = lambda a, v: F.when(F.coalesce(F.array_contains(a, v), F.lit(False)), "Yes").otherwise("No")
    flags = [has("__parts", g).alias("SPECIES_harv_parts_" + g.replace(" ", "_")) for g in PART_GROUPS]
    flags += [has("__uses", u).alias("SPECIES_uses_" + u.replace(" ", "_")) for u in uses]
    return df.select(*[c for c in df.columns if not c.startswith("__")], *flags)


def enriched_facts(fact: DataFrame, dimensions: Sequence[tuple[DataFrame, dict[str, str]]], identified: str | None = None) -> DataFrame:
    """Left joins of dimension tables in their order, each checked to have one row per key.

    Every dimension comes with a map from columns of the fact, or of dimensions before it, to its
    own key columns. ``identified`` names a column that must be known for a row to stay.
    """
    out = fact
    for dim, on in dimensions:
        out = enrich(out, unique_dimension(dim, list(on.values())), on)
    return out if identified is None else out.filter(F.col(identified).isNotNull())


def enrichment_coverage(df: DataFrame, comment: str, code: str, outside: Sequence[str], id: str = "id") -> DataFrame:
    """Mentions not matched to the taxonomy, by reason, with the respondents who made them."""
    is_out = in_set(comment, outside)
    genus = F.col(code).isNull() & ~is_out
    return df.agg(
        F.count(F.lit(1)).alias("n_mentions"),
        F.count_if(is_out).alias("n_outside"),
        F.count_if(genus).alias("n_genus"),
        F.count_distinct(F.when(is_out, F.col(id))).alias("ids_outside"),
        F.count_distinct(F.when(genus, F.col(id))).alias("ids_genus"),
        F.count_distinct(id).alias("ids_all"),
    )
