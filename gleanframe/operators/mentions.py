"""Ratios, rankings, cumulative curves and roll-ups over a mention table.

A mention row says that respondent ``id`` cited ``name`` (perhaps in an ``area``)
with an ``answer``. Votes are distinct (respondent, ...) tuples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gleanframe.functions.nulls import half_even, ratio, strict_sum
from gleanframe.operators.joins import enrich
from gleanframe.operators.ordering import prefix_sums, quantiles_of_counts, top_with_ties, value_counts
from gleanframe.session import materialise

UNSUSTAINABLE = "Unsustainable"
SUSTAINABLE = "Sustainable"


def citations(df: DataFrame, name: str = "name", id: str = "id") -> DataFrame:
    """Distinct respondents per name, incomplete pairs left out."""
    return (
        df.select(id, name).dropna("any").distinct()
        .groupBy(name).agg(F.count(F.lit(1)).alias("citations"))
    )


def sustainability_ratio(
    df: DataFrame,
    *,
    top: int | None = None,
    min_ratio: float | None = None,
    max_ratio: float | None = None,
    min_citations: int | None = None,
    max_citations: int | None = None,
    by: Sequence[str] = ("name", "life_form"),
    flagged: str = UNSUSTAINABLE,
) -> DataFrame:
    """Share of votes that call a name unsustainable, lowest first."""
    by = list(by)
    votes = df.select("id", "answer", *by).distinct()
    counts = votes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_citations"), F.count_if(F.col("answer") == flagged).alias("__bad")
    )
    if top is not None:
        # counted from the same distinct votes, whose shuffle both branches share: the count
        # per pair, the missing null filters and the join kind keep the optimizer from
        # pushing anything below it and scanning anew
        pairs = votes.groupBy("name", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
        cited = pairs.groupBy("name").agg(F.count("id").alias("n")).select(
            "name", F.when(F.col("name").isNotNull(), F.col("n")).alias("citations")
        )
        counts = enrich(counts, top_with_ties(cited, "citations", top).select("name"), ["name"], how="inner")
    out = counts.select(*by, ratio("__bad", "total_citations").alias("ratio_unsustainable"), "total_citations")
    for bound, test in (
        (min_ratio, lambda b: F.col("ratio_unsustainable") >= b),
        (max_ratio, lambda b: F.col("ratio_unsustainable") <= b),
        (min_citations, lambda b: F.col("total_citations") >= b),
        (max_citations, lambda b: F.col("total_citations") <= b),
    ):
        if bound is not None:
            out = out.filter(test(bound))
    return out.orderBy("ratio_unsustainable", *by)


def unsustainable_percent(df: DataFrame, count_mode: str = "mentions") -> DataFrame:
    """Per name: votes each way and the unsustainable percentage (2 digits, half to even).

    ``count_mode="rows"`` counts fan-out rows instead of distinct mentions.
    """
    rows = df if count_mode == "rows" else df.select("id", "name", "answer").distinct()
    counts = rows.groupBy("name").agg(
        F.count_if(F.col("answer") == UNSUSTAINABLE).alias("unsustainable"),
        F.count_if(F.col("answer") == SUSTAINABLE).alias("sustainable"),
    )
    share = ratio("unsustainable", F.col("unsustainable") + F.col("sustainable"), 100.0)
    return counts.withColumn("ratio", half_even(share, 2))


def share_above(per_name: DataFrame, column: str = "ratio", cut: float = 50.0) -> DataFrame:
    """Mean of a per-name percentage and the share of names strictly above ``cut``."""
    return per_name.agg(
        F.avg(column).alias("mean_ratio"),
        half_even(100.0 * F.avg((F.col(column) > cut).cast("double")), 2).alias("percent_above"),
    )


def singleton_share(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many names have exactly one mention row."""
    per_name = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    one = F.col("n") == 1
    return per_name.agg(
        F.count_if(one).alias("n_single"), F.count(F.lit(1)).alias("n_names"), F.avg(one.cast("double")).alias("share")
    )


def mentions_by_area(df: DataFrame, area: str = "area") -> DataFrame:
    """Votes each way per (area, name); blank and missing areas left out."""
    votes = df.filter(F.length(area) > 0).select("id", "name", "answer", area).distinct()
    counts = votes.groupBy(area, "name").agg(
        F.count_if(F.col("answer") == SUSTAINABLE).alias("sustainable"),
        F.count_if(F.col("answer") == UNSUSTAINABLE).alias("unsustainable"),
    )
    return counts.withColumn("total_citations", F.col("sustainable") + F.col("unsustainable"))


def sum_votes(cells: DataFrame, keys: Sequence[str], strict: bool = True) -> DataFrame:
    """Roll vote counts up to coarser keys."""
    add = strict_sum if strict else F.sum
    return cells.groupBy(*keys).agg(
        *[add(c).alias(c) for c in ("unsustainable", "sustainable", "total_citations")]
    )


def mentions_by_zone(cells: DataFrame, geography: DataFrame, area: str = "area", zone: str = "zone") -> DataFrame:
    """Roll (area, name) cells up to zones; every area joins, then incomplete rows go."""
    # from the geography's side, so that the cells are made once
    placed = enrich(geography.select(area, zone), cells, [area])
    return sum_votes(placed, ["name", zone]).dropna("any")


def mentions_rollup(cells: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """All roll-up levels in one pass, labelled by ``level``."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    level = F.concat_ws("+", *[F.when(F.grouping(k) == 0, F.lit(k)) for k in keys])
    return cells.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(
        F.when(F.length(level) > 0, level).otherwise("all").alias("level"),
        *[F.sum(c).alias(c) for c in ("unsustainable", "sustainable", "total_citations")],
    )


def mean_with_interval(per_group: DataFrame, value: str, z: float = 1.96) -> DataFrame:
    """Mean over groups with its normal interval."""
    stats = per_group.agg(
        F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("__se")
    )
    return stats.select(
        "mean",
        (F.col("mean") - z * F.col("__se")).alias("ci_lower"),
        (F.col("mean") + z * F.col("__se")).alias("ci_upper"),
    )


def cumulative_frequency(counts: DataFrame, name: str = "name", n: str = "citations") -> DataFrame:
    """Names by falling frequency with running total, running percent and rank."""
    ranked = prefix_sums(
        counts.select(name, F.col(n).alias("citations"), F.lit(1).alias("one")),
        [],
        [F.desc("citations"), F.asc(name)],
        ["citations", "one"],
    )
    return ranked.select(
        name,
        "citations",
        F.col("cum_citations"),
        (F.col("cum_citations") / F.col("all_citations") * 100).alias("cum_percent"),
        F.col("cum_one").cast("bigint").alias("rank"),
    )


def cumulative_cutoffs(curve: DataFrame, cutoffs: Sequence[float] = (50, 80, 95)) -> DataFrame:
    """Rank at which the running percent first reaches each cutoff."""
    cells = [F.min(F.when(F.col("cum_percent") >= c, F.col("rank"))).alias(str(c)) for c in cutoffs]
    row = curve.agg(*cells)
    pairs = F.explode(F.array(*[F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"`{c}`").alias("rank")) for c in cutoffs]))
    return row.select(pairs.alias("p")).select("p.cutoff", "p.rank")


def knee_point(curve: DataFrame, x: str = "rank", y: str = "cum_percent") -> DataFrame:
    """Point of a rising curve farthest above the chord between its ends."""
    ends = curve.agg(
        F.min_by(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), x).alias("a"),
        F.max_by(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), x).alias("b"),
    )
    # f(x) = y (xb - xa) - x (yb - ya) grows with the distance above the chord
    slope = ends.select(F.col("b.y") - F.col("a.y")).scalar()
    width = ends.select(F.col("b.x") - F.col("a.x")).scalar()
    height = F.round(F.col(y) * width - F.col(x) * slope, 9)
    best = curve.agg(F.max_by(F.struct(x, y), F.struct(height, -F.col(x))).alias("p"))
    return best.select(F.col("p")[x].alias(x), F.col("p")[y].alias(y))


def share_within(counts: DataFrame, keys: Sequence[str], n: str = "n", name: str = "pct") -> DataFrame:
    """Percent of the group total (or of everything, without keys).

    ``counts`` is a table of category counts: a group has one row per category, never
    one per input row. The grand total is a scalar, so no task sees all categories.
    """
    if not keys:
        return counts.withColumn(name, F.col(n) * 100.0 / counts.agg(F.sum(n)).scalar())
    return counts.withColumn(name, F.col(n) * 100.0 / F.sum(n).over(W.partitionBy(*keys)))


def frequencies(
    df: DataFrame, column: str, id: str = "id", missing: str | None = "Prefer not to answer", last: Sequence[str] = ("Other",)
) -> DataFrame:
    """Distinct respondents per category with the display order and the share.

    A null becomes the label ``missing``, or is left out where that is None. The order is by
    falling frequency, with ``last`` and ``missing`` at the end; positions come from prefix
    sums, so any number of categories will do.
    """
    category = F.col(column) if missing is None else F.coalesce(F.col(column), F.lit(missing))
    counts = (
        df.select(id, category.alias("category")).filter("category is not null").distinct()
        .groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    )
    ends = [*last, *([] if missing is None else [missing])]
    tail = F.array_position(F.array(*[F.lit(v) for v in ends]), F.col("category")) if ends else F.lit(0)
    placed = prefix_sums(counts.withColumn("__one", F.lit(1)), [], [tail, F.desc("n"), F.col("category")], ["__one", "n"])
    return placed.select(
        "category", "n", (F.col("n") * 100.0 / F.col("all_n")).alias("pct"), F.col("cum___one").cast("int").alias("position")
    )


def contingency_percent(df: DataFrame, row: str, col: str, columns: Sequence[str], digits: int = 1) -> DataFrame:
    """Row-normalised contingency table in percent, nulls left out.

    The total of a row is over all its values; those that ``columns`` does not name are
    counted in ``undeclared``.
    """
    known = df.filter(F.col(col).isNotNull())
    named = F.col(col).isin(list(columns))
    cells = known.groupBy(row).agg(
        *[F.count_if(F.col(col) == c).alias(c) for c in columns], F.count_if(~named).alias("undeclared"), F.count(F.lit(1)).alias("__all")
    )
    share = lambda c: half_even(ratio(F.col(f"`{c}`"), "__all", 100.0), digits)
    return cells.select(row, *[share(c).alias(c) for c in columns], "undeclared")


def area_coverage(df: DataFrame, geography: DataFrame, area: str = "area") -> DataFrame:
    """Distinct respondents per area, every area of the geography kept.

    Both tables have one row per area, so the full join is a union and one aggregate: the
    mentions are read once.
    """
    seen = df.select("id", area).distinct().groupBy(area).agg(F.count("id").alias("n_answers"))
    rest = [c for c in geography.columns if c != area]
    both = seen.unionByName(geography, allowMissingColumns=True)
    return both.groupBy(area).agg(*[F.max(c).alias(c) for c in ("n_answers", *rest)])


def area_total(df: DataFrame, area: str, size: str) -> DataFrame:
    """Total size over areas, each counted once at its largest value."""
    return df.groupBy(area).agg(F.max(size).alias("m")).agg(F.sum("m").alias("total_area"))


def histogram(df: DataFrame, value: str, by: Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width counts over the common range of all groups.

    ``df`` is read once: its value counts are stored and give both the range and the bins.
    """
    counts = materialise(value_counts(df, list(by), value))
    ends = counts.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    width = (hi - lo) / F.lit(float(bins))
    # values that are all the same fall into the first bin
    at = F.coalesce(F.floor(F.try_divide(F.col(value) - lo, width)), F.lit(0))
    slot = F.least(at, F.lit(bins - 1)).cast("int")
    return counts.groupBy(*by, slot.alias("bin")).agg(F.sum("n").alias("n"))


def boxplot(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Quartiles and whiskers (extreme values within 1.5 box lengths); ``df`` is read once."""
    by = list(by)
    counts = materialise(value_counts(df, by, value))
    box = quantiles_of_counts(counts, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    values = enrich(counts.drop("n"), box, by, null_keys="match")
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return values.groupBy(*by, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
    )


def density(
    df: DataFrame, by: str, value: str, lo: float | None = None, hi: float | None = None, points: int = 64, bandwidth: float = 1.0
) -> DataFrame:
    """Gaussian kernel density per class on a grid, by default over the range of the values.

    Values are first spread linearly over the grid cells they fall between, so the
    kernel sum runs over at most ``points`` bins a class whatever the row count. Values
    beyond a given ``lo`` or ``hi`` are left out of sum and total; ``n_outside`` counts them.
    """
    every = materialise(df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n")))
    if lo is None or hi is None:
        first = every.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
        if first.lo is None:
            lo, hi = 0.0, 1.0
        lo = float(first.lo) if lo is None and first.lo is not None else float(lo)
        hi = float(first.hi) if hi is None and first.hi is not None else float(hi)
        hi = hi if hi > lo else lo + 1.0
    step = (hi - lo) / (points - 1)
    within = F.col(value).between(lo, hi)
    at = (F.col(value) - lo) / step
    left = F.greatest(F.lit(0), F.least(F.floor(at), F.lit(points - 2)))
    frac = at - left
    pieces = F.explode(
        F.array(
            F.struct(left.cast("int").alias("bin"), (F.lit(1.0) - frac).alias("w")),
            F.struct((left + 1).cast("int").alias("bin"), frac.alias("w")),
        )
    )
    bins = (
        every.filter(within).select(by, "n", pieces.alias("p"))
        .groupBy(by, "p.bin").agg(F.sum(F.col("p.w") * F.col("n")).alias("w"))
    )
    totals = every.groupBy(by).agg(
        F.sum(F.when(within, F.col("n"))).alias("total"), F.coalesce(F.sum(F.when(~within, F.col("n"))), F.lit(0)).alias("n_outside")
    )
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    z = (F.col("point") - F.col("bin")) * (step / bandwidth)
    kernel = F.exp(-0.5 * z * z) / (bandwidth * (2 * 3.141592653589793) ** 0.5)
    summed = (
        bins.select(by, "bin", "w", grid.alias("point")).groupBy(by, "point").agg(F.sum(F.col("w") * kernel).alias("s"))
    )
    out = enrich(summed, totals, [by], null_keys="match")
    return out.select(by, (F.lit(lo) + F.col("point") * step).alias("x"), (F.col("s") / F.col("total")).alias("density"), "n_outside")


def map_layer(geography: DataFrame, cells: DataFrame, on: Sequence[str], name: str | None = None) -> DataFrame:
    """Counts on every geography row, percent unsustainable, step class and scale maximum.

    One name, with the maximum over all names' cells, or all names together with theirs. The
    cells, a row per place and name, are stored and so made once. Any other columns of the
    geography, such as ``rings``, come along.
    """
    if name is None and "name" in cells.columns:
        cells = sum_votes(cells, list(on))
    cells = materialise(cells)
    top = cells.agg(F.max("total_citations")).scalar()
    chosen = cells if name is None else cells.filter(F.col("name") == name)
    layer = enrich(geography, chosen, list(on))
    pct = F.when(
        F.col("total_citations") > 0, half_even(F.col("unsustainable") * 100.0 / F.col("total_citations"), 2)
    )
    out = layer.withColumn("prop_unsustainable", pct).withColumn("global_max", top)
    p = F.col("prop_unsustainable")
    step: Column = F.when(p < 25, 1).when(p < 50, 2).when(p < 75, 3).when(p <= 100, 4)
    return out.withColumn("step", step)
