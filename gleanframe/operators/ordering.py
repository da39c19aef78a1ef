"""Global order without a one-task window: prefix sums, ranks, quantiles, top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gleanframe.operators.joins import enrich
from gleanframe.session import materialise


def prefix_sums(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], values: Sequence[str]
) -> DataFrame:
    """Running totals ``cum_<v>`` and group totals ``all_<v>`` in ``order`` within ``by``.

    ``df`` is already reduced to one row per distinct sort key. Rows are range
    partitioned on (by, order), the partition id is written to the shared folder with
    them, per-partition totals become offsets, and each partition is summed on its
    own. A group holding most rows spreads over many partitions.
    """
    by = list(by)
    placed = materialise(
        df.repartitionByRange(*by, *order).withColumn("__pid", F.spark_partition_id())
    )
    parts = placed.groupBy(*by, "__pid").agg(*[F.sum(v).alias(f"__s_{v}") for v in values])
    # one row per (group, partition): bounded by the partition count
    whole = W.partitionBy(*(by or [F.lit(0)]))
    before = whole.orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        *by,
        "__pid",
        *[F.coalesce(F.sum(f"__s_{v}").over(before), F.lit(0)).alias(f"__o_{v}") for v in values],
        *[F.sum(f"__s_{v}").over(whole).alias(f"all_{v}") for v in values],
    )
    within = W.partitionBy(*by, "__pid").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    joined = enrich(placed, offsets, by + ["__pid"], null_keys="match")
    return joined.select(
        *df.columns,
        *[(F.col(f"__o_{v}") + F.sum(v).over(within)).alias(f"cum_{v}") for v in values],
        *[f"all_{v}" for v in values],
    )


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their counts, nulls left out."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group (the ``(n-1)p`` rule), plus ``n``.

    Works on counts per distinct value, so no group is ever held in one task.
    """
    return quantiles_of_counts(value_counts(df, list(by), value), by, value, probs)


def quantiles_of_counts(counts: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """The same from rows (``by``, ``value``, ``n``) with distinct values."""
    by = list(by)
    cum = prefix_sums(counts, by, [value], ["n"])
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n")
    cells = []
    for name, p in probs.items():
        h = (F.col("all_n") - 1) * F.lit(float(p))
        for part, at in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            cells.append(F.max(F.when((first <= at) & (at < last), F.col(value))).alias(f"__{part}_{name}"))
    got = cum.groupBy(*by).agg(F.max("all_n").alias("n"), *cells)
    out = []
    for name, p in probs.items():
        h = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return got.select(*by, "n", *out)


def values_at_positions(cum: DataFrame, by: Sequence[str], value: str, wanted: DataFrame, position: str) -> DataFrame:
    """Look up the value standing at given 1-based positions of a ``prefix_sums`` result.

    Both sides are sorted together, so no (value, position) pairs are formed. ``wanted``
    holds ``by``, ``position`` and any payload columns.
    """
    by = list(by)
    payload = [c for c in wanted.columns if c not in by]
    steps = cum.select(
        *by,
        F.col("cum_n").cast("double").alias("__at"),
        F.lit(1).alias("__kind"),
        F.col(value).alias("__v"),
        *[F.lit(None).cast(wanted.schema[c].dataType).alias(c) for c in payload],
    )
    asks = wanted.select(
        *by,
        F.col(position).cast("double").alias("__at"),
        F.lit(0).alias("__kind"),
        F.lit(None).cast(cum.schema[value].dataType).alias("__v"),
        *payload,
    )
    # the answer to an ask is the first step at or after it: its value is the smallest
    # one whose running count reaches the position
    placed = materialise(
        steps.unionByName(asks)
        .repartitionByRange(*by, "__at", "__kind")
        .withColumn("__pid", F.spark_partition_id())
    )
    # counted from the end: a frame that reaches the end is summed anew for every row, one that grows is not
    following = W.partitionBy(*by, "__pid").orderBy(F.desc("__at"), F.desc("__kind")).rowsBetween(W.unboundedPreceding, 0)
    firsts = placed.groupBy(*by, "__pid").agg(F.min("__v").alias("__first"))
    later = W.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("__pid")).rowsBetween(W.unboundedPreceding, -1)
    carry = firsts.withColumn("__next", F.last("__first", ignorenulls=True).over(later))
    local = placed.withColumn("__here", F.last("__v", ignorenulls=True).over(following))
    return enrich(
        local.filter("__kind = 0"), carry.select(*by, "__pid", "__next"), by + ["__pid"], null_keys="match"
    ).select(*by, *payload, F.coalesce("__here", "__next").alias(value))


def top_with_ties(df: DataFrame, by: str | Column, k: int) -> DataFrame:
    """Rows ranked k-th or better, ties included.

    The k-th largest value comes from a distributed top-k; the rows are then filtered,
    so a long tie never lands in one task.
    """
    key = F.col(by) if isinstance(by, str) else by
    kth = df.select(key.alias("__k")).filter(F.col("__k").isNotNull()).orderBy(F.desc("__k")).limit(k)
    return df.filter(key >= kth.agg(F.min("__k")).scalar())


def top_exact(df: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """Exactly k rows; ``order`` must break all ties."""
    return df.orderBy(*order).limit(k)


def running_by_day(df: DataFrame, timestamp: str) -> DataFrame:
    """Rows per day and their running total.

    The window sees one row per calendar day, about 36,500 a century.
    """
    daily = df.groupBy(F.to_date(timestamp).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy(F.lit(0)).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return daily.select(
        "day", F.date_format("day", "MMM yyyy").alias("month"), "n", F.sum("n").over(upto).alias("cum_n")
    )
