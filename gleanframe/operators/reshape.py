"""Long/wide reshaping with fixed output schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gleanframe.functions import text


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "column_name", value: str = "value") -> DataFrame:
    """Unpivot text columns, dropping nulls."""
    wide = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in columns])
    return wide.unpivot(list(ids), list(columns), name, value).filter(F.col(value).isNotNull())


def widen_lists(df: DataFrame, ids: Sequence[str], names: str, value: str, order: str, categories: Sequence[str]) -> DataFrame:
    """One column per category, each a list ordered by ``order``; null when empty."""
    packed = F.array_sort(F.collect_list(F.struct(order, value)))
    out = df.groupBy(*ids).pivot(names, list(categories)).agg(packed)
    cells = [F.transform(F.col(f"`{c}`"), lambda s: s[value]) for c in categories]
    return out.select(*ids, *[F.when(F.size(x) > 0, x).alias(c) for c, x in zip(categories, cells)])


def widen_first(df: DataFrame, ids: Sequence[str], names: str, value: str, order: str, categories: Sequence[str]) -> DataFrame:
    """One column per category holding the value that comes first in ``order``."""
    picked = F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    return df.groupBy(*ids).pivot(names, list(categories)).agg(picked)


def unnest_parallel(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Explode list columns side by side; length-one lists repeat, missing ones give null."""
    longest = F.greatest(F.lit(1), *[F.coalesce(F.size(c), F.lit(0)) for c in columns])

    def stretched(c: str) -> Column:
        # a null list would null the whole zip, so it becomes a list of nulls
        one = F.when(F.coalesce(F.size(c), F.lit(0)) <= 1, F.array_repeat(F.get(c, F.lit(0)), longest))
        return one.otherwise(F.col(c)).alias(c)

    zipped = F.explode(F.arrays_zip(F.sequence(F.lit(1), longest).alias("__i"), *[stretched(c) for c in columns]))
    others = [c for c in df.columns if c not in set(columns)]
    out = df.select(*others, zipped.alias("__z"))
    return out.select(*[F.col("__z")[c].alias(c) if c in set(columns) else F.col(c) for c in df.columns])


def split_rows(df: DataFrame, column: str, pattern: str = r",\s*") -> DataFrame:
    """One row per part of a delimited cell, trimmed."""
    parts = F.explode(F.split(F.col(column), pattern))
    return df.select(*[F.col(c) if c != column else parts.alias(c) for c in df.columns]).withColumn(
        column, F.trim(column)
    )


def presence_flags(
    df: DataFrame, ids: Sequence[str], category: str, categories: Sequence[str], prefix: str, fill: str = "No"
) -> DataFrame:
    """One Yes/``fill`` column per category; null categories get no column."""
    flags = [
        F.coalesce(F.max(F.when(F.col(category) == c, F.lit("Yes"))), F.lit(fill)).alias(prefix + c)
        for c in categories
    ]
    return df.groupBy(*ids).agg(*flags)


def category_counts(
    df: DataFrame, ids: Sequence[str], category: str, categories: Sequence[str], n: Column | None = None
) -> DataFrame:
    """One count column per category, zero when absent."""
    weight = F.lit(1) if n is None else n
    cells = [
        F.coalesce(F.sum(F.when(F.col(category) == c, weight)), F.lit(0)).cast("bigint").alias(c)
        for c in categories
    ]
    return df.groupBy(*ids).agg(*cells)


def coalesce_rows(df: DataFrame, ids: Sequence[str], order: str) -> DataFrame:
    """First non-null value of every column per key, in ``order``."""
    rest = [c for c in df.columns if c not in set(ids) and c != order]
    return df.groupBy(*ids).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest]
    )


def filled_columns(df: DataFrame, candidates: Sequence[str] | None = None) -> list[str]:
    """Columns holding at least one non-null value (one pass, one row back)."""
    names = list(candidates or df.columns)
    seen = df.agg(*[F.bool_or(F.col(c).isNotNull()).alias(c) for c in names]).first()
    return [c for c in names if seen[c]]


def drop_empty_columns(df: DataFrame, candidates: Sequence[str] | None = None) -> DataFrame:
    names = set(candidates or df.columns)
    alive = set(filled_columns(df, sorted(names)))
    return df.select(*[c for c in df.columns if c not in names or c in alive])


def rename_in_order(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """New names by position, one for every column; two equal names are refused."""
    if len(names) != len(df.columns) or len({n.lower() for n in names}) != len(names):
        raise ValueError(f"{len(df.columns)} different names are needed")
    return df.toDF(*names)


def across(df: DataFrame, columns: Sequence[str], fn) -> DataFrame:
    """Apply one expression to many columns in a single projection."""
    chosen = set(columns)
    return df.select(*[fn(F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns])


def option_label(x: Column | str) -> Column:
    """``code____Some_label`` -> ``Some label``."""
    return text.sentence_case(F.replace(text.replace_first(x, ".*____"), F.lit("_"), F.lit(" ")))
