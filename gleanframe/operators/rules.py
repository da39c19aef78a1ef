"""Matching answers with legal rules at several administrative levels, and scoring them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gleanframe.functions.nulls import closed_set, recode_pattern
from gleanframe.functions.text import normalise_name
from gleanframe.operators.joins import enrich, keep_matched_if_any
from gleanframe.operators.mentions import share_within
from gleanframe.session import materialise, written

# Level names in the rule table and the status labels of the report.
LEVELS = {
    "department": ("Département",),
    "region": ("Ancienne région", "Région"),
    "national": ("État", "Territoire"),
}
NO_RULE = "No regulation/protection"
STATUS_LEVELS = (
    NO_RULE, "National-level protection", "Regional-level protection", "Department-level protection", "Regulation",
)
REGULATION_LABELS = ("Réglementation", "Réglementation sans objet")
PROTECTION_PATTERNS = (
    ("départementale", "Department-level protection"),
    ("nationale", "National-level protection"),
    ("régionale", "Regional-level protection"),
)


def relevant_rules(rules: DataFrame) -> DataFrame:
    """Protections and regulations only."""
    return rules.filter((F.col("grouping") == "Protection") | (F.col("status_code") == "REGL"))


def match_rules(
    answers: DataFrame, rules: DataFrame, places: dict[str, str | None], identity: Sequence[str] = ()
) -> DataFrame:
    """Stack the matches of every level; unmatched answers stay with a null status.

    ``places`` maps a level to the answer column its place must equal (None: no place). Places
    are normalised on both sides: accents, hyphens and apostrophes do not keep them apart.
    The rule table is reduced to distinct (name, level, place, status) first, so that two texts of
    one status count once; with ``identity`` (a citation, say) each text counts by itself.
    """
    # one join for all levels: each answer is repeated per level with that level's place
    asked = F.explode(
        F.array(
            *[
                F.struct(F.lit(level).alias("rule_level"), (F.lit("") if place is None else normalise_name(place)).alias("rule_place"))
                for level, place in places.items()
            ]
        )
    )
    level_of = None
    for level in places:
        hit = F.col("level").isin(list(LEVELS[level]))
        level_of = F.when(hit, level) if level_of is None else level_of.when(hit, level)
    anywhere = [level for level, place in places.items() if place is None]
    table = (
        rules.select("name", level_of.alias("rule_level"), "place", "grouping", "status_label", *identity)
        .filter(F.col("rule_level").isNotNull())
        .select(
            "name", "rule_level",
            F.when(F.col("rule_level").isin(anywhere), "").otherwise(normalise_name("place")).alias("rule_place"),
            "grouping", "status_label", *identity,
        )
        .distinct()
    )
    rows = answers.select(*answers.columns, asked.alias("__a")).select(*answers.columns, "__a.*")
    return enrich(rows, table, ["name", "rule_level", "rule_place"]).drop("rule_level", "rule_place")


def status_group(df: DataFrame) -> DataFrame:
    """Status label to report group; unknown labels become null, missing ones "no rule"."""
    label = F.col("status_label")
    grouped = F.when(label.isin(list(REGULATION_LABELS)), "Regulation").otherwise(
        recode_pattern(label, PROTECTION_PATTERNS)
    )
    return df.withColumn("status_group", closed_set(F.coalesce(grouped, F.lit(NO_RULE)), STATUS_LEVELS))


def answers_with_status(
    answers: DataFrame, rules: DataFrame, places: dict[str, str | None], answer: str = "regulation", identity: Sequence[str] = ()
) -> DataFrame:
    """Answers against the law: match, keep matched rows where a name has any, tidy the answers."""
    rules = relevant_rules(rules)
    # written once: read for the places that a name is cited at, and for the matching of every answer
    answers = written(answers, "answers")
    cited = answers.select(*dict.fromkeys(["name", *(p for p in places.values() if p is not None)])).distinct()
    matched = match_rules(answers, rules, places, identity)
    matched_places = match_rules(cited, rules, places)
    kept = status_group(keep_matched_if_any(matched, ["name"], F.col("grouping").isNotNull(), matched_places))
    tidy = recode_pattern(answer, (("yes", "Yes"), ("no", "No")), ignore_case=True)
    known = rules.select("name").distinct().withColumn(
        "national_status", F.lit("At least 1 regulation or protection")
    )
    distinct = kept.filter(F.col(answer).isNotNull()).withColumn(answer, tidy).distinct()
    return enrich(distinct, known, ["name"])


def status_shares(df: DataFrame, answer: str = "regulation") -> DataFrame:
    """Counts per (answer, status) with the share within the answer and of all rows."""
    # a row per answer and status, written once: the grand total would run the matching a second time
    counts = materialise(df.groupBy(answer, "status_group").agg(F.count(F.lit(1)).alias("n")))
    return share_within(share_within(counts, [answer]), [], name="pct_all")


def answer_shares(df: DataFrame, answer: str = "regulation") -> DataFrame:
    """Counts per answer alone with the share of all rows."""
    return share_within(materialise(df.groupBy(answer).agg(F.count(F.lit(1)).alias("n"))), [])


def score_answers(df: DataFrame, answer: str = "regulation") -> DataFrame:
    """"Yes" with a rule or "No" without one is correct; everything else is not."""
    a, s = F.col(answer), F.col("status_group")
    verdict = (
        F.when(a.contains("Yes") & (s != NO_RULE), "Correct")
        .when(a.contains("No") & (s == NO_RULE), "Correct")
        .otherwise("Incorrect")
    )
    return df.withColumn("verdict", verdict)


def verdict_shares(df: DataFrame, answer: str = "regulation") -> DataFrame:
    counts = score_answers(df, answer).groupBy(answer, "status_group", "verdict").agg(F.count(F.lit(1)).alias("n"))
    return share_within(counts, [answer])


def regulated_elsewhere(df: DataFrame, answer: str = "regulation") -> DataFrame:
    """Wrong "Yes" answers by whether the name has a rule anywhere."""
    wrong = df.filter((F.col(answer) == "Yes") & (F.col("status_group") == NO_RULE))
    return wrong.groupBy("national_status").agg(F.count(F.lit(1)).alias("n"))


def unregulated_share(votes: DataFrame, flagged: str = "Unsustainable") -> DataFrame:
    """Of the distinct flagged mentions, how many have no rule."""
    bad = votes.filter(F.col("answer") == flagged)
    none = F.count_if(F.col("status_group") == NO_RULE)
    return bad.agg(
        F.count(F.lit(1)).alias("total_unsustainable"),
        none.alias("unsustainable_unregulated"),
        F.try_divide(100.0 * none, F.count(F.lit(1)).cast("double")).alias("percent"),
    )


def unprotected_ratios(votes: DataFrame, keys: Sequence[str] = ("name",), flagged: str = "Unsustainable") -> DataFrame:
    """Per name without a rule: mentions, flagged mentions and their ratio, highest first."""
    free = votes.filter(F.col("status_group") == NO_RULE)
    out = free.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_citations"),
        F.count_if(F.col("answer") == flagged).alias("unsustainable_citations"),
    )
    share = F.col("unsustainable_citations") / F.col("total_citations")
    return out.withColumn("ratio_unsustainable", share).orderBy(F.desc("ratio_unsustainable"), *keys)
