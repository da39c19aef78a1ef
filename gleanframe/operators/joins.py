"""Joins with the null and duplicate rules survey tables need.

No join here carries a broadcast hint: a side is broadcast only when Spark's own
size estimate, or AQE's measured shuffle size, is under
``spark.sql.autoBroadcastJoinThreshold``; otherwise the sort-merge join runs and
AQE splits a hot key's partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gleanframe.session import written


def unique_dimension(dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop exact duplicates; fail when a key still maps to two different rows."""
    keys = list(keys)
    rest = [c for c in dim.columns if c not in keys]
    packed = F.struct(*rest)
    out = dim.groupBy(*keys).agg(F.min(packed).alias("lo"), F.max(packed).alias("hi"))
    # the test is a filter: a projection would be pruned when only the key is read
    checked = F.when(F.col("lo").eqNullSafe(F.col("hi")), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("dimension key with two values: "), F.to_json(F.struct(*keys)))).cast("boolean")
    )
    return out.filter(checked).select(*keys, *[F.col("lo")[c].alias(c) for c in rest])


def enrich(
    fact: DataFrame,
    dim: DataFrame,
    on: Sequence[str] | dict[str, str],
    null_keys: str = "never",
    how: str = "left",
) -> DataFrame:
    """Join a dimension; ``on`` may map fact columns to dimension columns.

    ``how`` is inner, left, right or full. ``null_keys="match"`` pairs a null key with a
    null key. Right and full joins are an inner or left join plus the dimension rows whose
    key no fact row has: an outer join cannot be split when its null-supplying side is
    skewed, while these two can, and a small dimension is still broadcast.
    """
    pairs = dict(on) if isinstance(on, dict) else {k: k for k in on}
    rest = [c for c in dim.columns if c not in pairs.values()]
    tagged = dim.select(*[F.col(d).alias(f"__k{i}") for i, d in enumerate(pairs.values())], *rest)

    def same(left: DataFrame) -> Column:
        cond = None
        for i, f in enumerate(pairs):
            l, r = left[f], tagged[f"__k{i}"]
            test = l.eqNullSafe(r) if null_keys == "match" else l == r
            cond = test if cond is None else cond & test
        return cond

    matched = fact.join(tagged, same(fact), "left" if how in ("left", "full") else "inner").select(
        *[fact[c] for c in fact.columns], *[tagged[c] for c in rest]
    )
    if how in ("inner", "left"):
        return matched
    keys = fact.select(*pairs).distinct()
    alone = tagged.join(keys, same(keys), "left_anti")
    at = {f: F.col(f"__k{i}") for i, f in enumerate(pairs)}
    return matched.unionByName(
        alone.select(
            *[at.get(c, F.lit(None)).cast(fact.schema[c].dataType).alias(c) for c in fact.columns], *rest
        )
    )


def natural_join(left: DataFrame, right: DataFrame, how: str = "left", null_keys: str = "never") -> DataFrame:
    """Join on every column name both sides share."""
    shared = [c for c in left.columns if c in set(right.columns)]
    if not shared:
        raise ValueError("no shared column to join on")
    return enrich(left, right, shared, null_keys, how)


def prefix_columns(df: DataFrame, prefix: str, keep: Sequence[str]) -> DataFrame:
    """Prefix every column but the keys."""
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in set(keep)})


def keep_members(df: DataFrame, members: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in another result."""
    return df.join(members.select(*on), list(on), "left_semi")


def spread_group_value(df: DataFrame, keys: Sequence[str], **aggregates) -> DataFrame:
    """Put group aggregates on every row.

    A map-side combined aggregate is joined back instead of a window, so that one
    hot group never has to be sorted in a single task.
    """
    # the row count keeps an earlier distinct of ``df`` in the plan, so its shuffle is shared
    per_group = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[c.alias(n) for n, c in aggregates.items()])
    return enrich(df, per_group.filter("__n > 0").drop("__n"), list(keys), null_keys="match")


def keep_matched_if_any(df: DataFrame, keys: Sequence[str], matched, groups: DataFrame | None = None) -> DataFrame:
    """Keep a group's matched rows if it has any, else the whole group.

    ``groups`` may be a shorter table that has a match in the same groups as ``df``. Its flags are written
    once, so that few groups are broadcast and ``df`` is not shuffled to meet them.
    """
    hit = F.coalesce(matched, F.lit(False))
    if groups is None:
        flagged = spread_group_value(df, keys, __any=F.bool_or(hit))
    else:
        flags = written(groups.groupBy(*keys).agg(F.bool_or(hit).alias("__any")), "matched-groups")
        flagged = enrich(df, flags, list(keys), null_keys="match")
    return flagged.filter(~F.col("__any") | hit).select(*df.columns)


def propagate_any(df: DataFrame, keys: Sequence[str], cond, column: str, value: str) -> DataFrame:
    """Overwrite ``column`` with ``value`` on all rows of a group in which ``cond`` holds once."""
    flagged = spread_group_value(df, keys, __any=F.bool_or(F.coalesce(cond, F.lit(False))))
    new = F.when(F.col("__any"), F.lit(value)).otherwise(F.col(column))
    return flagged.withColumn(column, new).select(*df.columns)


def list_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys in both lists, only left, only right, and the overlap rates in percent."""
    both = (
        left.select(key).distinct().withColumn("in_left", F.lit("yes"))
        .join(right.select(key).distinct().withColumn("in_right", F.lit("yes")), key, "full")
        .filter(F.col(key).isNotNull())
    )
    l, r = F.col("in_left").isNotNull(), F.col("in_right").isNotNull()
    n_both, n_left, n_right = F.count_if(l & r), F.count_if(l), F.count_if(r)
    return both.agg(
        n_both.alias("n_both"),
        F.count_if(l & ~r).alias("n_only_left"),
        F.count_if(~l & r).alias("n_only_right"),
        F.try_divide(100.0 * n_both, n_left.cast("double")).alias("pct_of_left"),
        F.try_divide(100.0 * n_both, n_right.cast("double")).alias("pct_of_right"),
    )


def list_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of one list only, with ``side`` "left" or "right"; null keys are in neither list."""
    counted = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    held = counted.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r")).filter("l != r")
    return held.select(key, F.when(F.col("l") == 1, "left").otherwise("right").alias("side"))
