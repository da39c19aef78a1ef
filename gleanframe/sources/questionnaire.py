"""The questionnaire export stand-in: events written as a very wide answer table.

One event is one respondent. Every column is an SQL expression over ``events`` that
Spark and the checking database read alike, so both sides see the same export.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanframe.sources.standins import table

#: Species groups in the export and when a respondent filled them in.
GROUP_FILLED = {
    3: "event_type IN ('click', 'view', 'signup')",
    4: "value >= 40",
    6: "hour(ts) < 9",
    8: "hour(ts) >= 19",
}
FIRST_GROUPS = (3, 4)

_OPTIONS = {
    "harv_parts": ("Leaves", "Flowers", "Aerial_part_(stems)", "Underground_organs", "Whole_plant", "Bark"),
    "uses": ("Food_industry", "Medical_use", "Craft", "Ornamental_plants"),
    "risk": ("Trampling", "Uprooting"),
    "harv_type": ("Individual", "Collective"),
    "company_type": ("Small__company", "Large_company"),
    "unadapted_regulation_cause": ("Too_strict", "Not_enforced"),
}


def _species_columns(group: int, filled: str) -> list[tuple[str, str]]:
    first = group in FIRST_GROUPS
    cols: list[tuple[str, str]] = []

    def add(q_first: int, q_further: int, suffix: str, expr: str) -> None:
        q = q_first if first else q_further
        code = f"G{group}Q{q:05d}" if q < 10 else f"G{group}Q000{q}"
        cols.append((code + suffix, f"CASE WHEN {filled} THEN {expr} END"))

    shift = {3: 0, 4: 7, 6: 13, 8: 19}[group]
    add(1, 1, "____Name", (
        f"CASE WHEN value < 2 THEN ' ' WHEN day(ts) <= 12 THEN concat('Taxon ', CAST((user_id + {shift}) % 40 AS STRING), "
        f"',   Taxon ', CAST((day(ts) + {shift}) % 40 AS STRING)) ELSE concat(' Taxon ', CAST((user_id + {shift}) % 40 AS STRING)) END"))
    if not first:
        add(2, 2, "____Sustainable", "CASE WHEN value < 25 THEN 'Yes' WHEN value < 60 THEN 'No' END")
    add(2, 4, "____Department", (
        "CASE event_type WHEN 'click' THEN 'Val-d''Oise (95)' WHEN 'view' THEN 'Côte-d''Or (21)' "
        "WHEN 'signup' THEN 'Haute-Corse (2B)' WHEN 'error' THEN 'Isère (38)' ELSE 'Paris (75)' END"))
    add(4, 6, "____Presence", (
        "CASE WHEN hour(ts) < 6 THEN 'Rare' WHEN hour(ts) < 12 THEN 'Locally abundant' "
        "WHEN hour(ts) < 18 THEN 'Widely abundant' WHEN value < 50 THEN 'I don''t know' END"))
    add(5, 7, "____Spread", "CASE WHEN value < 30 THEN 'Localised (few sites)' ELSE 'Widespread (many sites)' END")
    add(10, 12, "____Start", "CAST(1990 + day(ts) AS STRING)")
    add(11, 13, "____State", "CASE WHEN value < 35 THEN 'Stable' WHEN value < 80 THEN 'A decline of the resource' END")
    add(12, 14, "____Variation", (
        "CASE WHEN day(ts) < 8 THEN 'It is stable' WHEN day(ts) < 16 THEN 'An increase' "
        "WHEN day(ts) < 24 THEN 'A decrease' ELSE 'Very variable' END"))
    add(13, 15, "____Intensity", "CASE WHEN user_id < 50 THEN 'High' WHEN user_id < 120 THEN 'Low' END")
    for option in ("Trend", "Second_trend"):
        # two columns share one question, so its cell is a list
        add(18, 20, f"_SQ00{1 if option == 'Trend' else 2}____{option}",
            "CASE WHEN value < 45 THEN 'Yes' ELSE 'No' END" if option == "Trend"
            else "CASE WHEN day(ts) > 20 THEN 'Yes' END")
    add(19, 21, "____Trend_risk", "CASE WHEN hour(ts) < 12 THEN 'Yes' ELSE 'No' END")
    add(20, 22, "____Regulated", (
        "CASE WHEN user_id < 60 THEN 'Yes, it is regulated' WHEN user_id < 130 THEN 'No, no known regulation' "
        "ELSE 'I don''t know' END"))
    add(21, 23, "____Adapted", "CASE WHEN user_id < 30 THEN 'Yes' WHEN user_id < 60 THEN 'No' END")

    ticks = ("value < 20", "value BETWEEN 10 AND 40", "hour(ts) >= 12", "day(ts) < 6", "user_id < 40", "value > 90")
    for field, q1, q2 in (("harv_parts", 6, 8), ("uses", 7, 9), ("risk", 17, 19)):
        for i, option in enumerate(_OPTIONS[field]):
            add(q1, q2, f"_SQ{i + 1:03d}____{option}", f"CASE WHEN {ticks[i]} THEN 'Yes' ELSE 'No' END")
    for field, q1, q2 in (("harv_type", 8, 10), ("company_type", 9, 11), ("unadapted_regulation_cause", 22, 24)):
        for i, option in enumerate(_OPTIONS[field]):
            add(q1, q2, f"_SQ{i + 1:03d}____{option}", f"CASE WHEN {ticks[i + 2]} THEN 'Yes' END")
        add(q1, q2, "__other__Other", "CASE WHEN value > 100 THEN concat('other ', event_type) END")
    return cols


def _profile_columns() -> list[tuple[str, str]]:
    plain = [
        (1, "Gender", "CASE WHEN user_id < 70 THEN 'Female' WHEN user_id < 140 THEN 'Male' END"),
        (2, "Age", "CASE WHEN day(ts) < 6 THEN 'Under 26 years' WHEN day(ts) < 14 THEN '26 to 35 years' "
                   "WHEN day(ts) < 22 THEN '36 to 50 years' WHEN day(ts) < 28 THEN 'Over 50 years' END"),
        (4, "Env_studies", "CASE WHEN value < 50 THEN 'Yes' ELSE 'No' END"),
        (6, "Harvester", "CASE WHEN value < 60 THEN 'Yes' WHEN value < 120 THEN 'No' END"),
        (7, "Start", "CAST(1980 + hour(ts) AS STRING)"),
        (8, "Nb_species", "CASE WHEN hour(ts) < 8 THEN 'Only one' WHEN hour(ts) < 16 THEN '1 to 5' WHEN hour(ts) < 20 THEN '5 to 30' END"),
        (9, "Status", "CASE WHEN event_type = 'click' THEN 'For leisure (family)' WHEN event_type = 'view' THEN 'A main income' "
                      "ELSE 'Other' END"),
        (10, "Status_company", "CASE WHEN event_type = 'view' THEN 'Own company' END"),
        (11, "Harv_group", "CASE WHEN value < 15 THEN 'Yes' END"),
        (12, "Name_group", "CASE WHEN value < 15 THEN concat('Group ', CAST(hour(ts) AS STRING)) END"),
        (14, "Organisation", "CASE WHEN value > 70 THEN concat('Org ', CAST(user_id % 9 AS STRING)) END"),
        (15, "Job", "CASE WHEN value > 70 THEN 'Adviser' END"),
        (16, "Size", "CASE WHEN value > 90 THEN '10 to 50' END"),
        (17, "Nb_org_species", "CASE WHEN value > 90 THEN '5 to 30' END"),
    ]
    cols = [(f"G21Q{q:05d}____{label}" if q < 10 else f"G21Q000{q}____{label}", expr) for q, label, expr in plain]
    multi = [
        (3, ("Secondary", "University")), (5, ("Farmers", "Retired")), (13, ("No_affiliated_organisation", "Buyer_of_wild_plants")),
    ]
    for q, options in multi:
        code = f"G21Q{q:05d}" if q < 10 else f"G21Q000{q}"
        for i, option in enumerate(options):
            cols.append((f"{code}_SQ{i + 1:03d}____{option}", f"CASE WHEN {('value < 40', 'hour(ts) < 10')[i]} THEN 'Yes' END"))
        cols.append((f"{code}__other__Other", "CASE WHEN value > 110 THEN 'Something else' END"))
    # a question nobody answered
    cols.append(("G21Q00018____Unused", "CAST(NULL AS STRING)"))
    return cols


def columns() -> list[tuple[str, str]]:
    """(column name, SQL expression over events) in questionnaire order."""
    out = [("GsuppQsupp____Known_unsustainable", "CASE WHEN value < 20 THEN 'No' WHEN value < 60 THEN 'Yes' END")]
    for group, filled in GROUP_FILLED.items():
        out += _species_columns(group, filled)
    return out + _profile_columns()


def wide_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export: ``id`` and one text column per question item."""
    events = table(spark, sf_dir, "events")
    return events.selectExpr("event_id AS id", *[f"{expr} AS `{name}`" for name, expr in columns()])


def wide_survey_sql() -> str:
    body = ",\n".join(f'{expr} AS "{name}"' for name, expr in columns())
    return f"SELECT event_id AS id,\n{body}\nFROM events"
