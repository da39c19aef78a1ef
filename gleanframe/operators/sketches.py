"""Distinct counts and quantiles that add up: sketches per cell, merged up a roll-up chain.

A cell's sketches are computed once and stored; every coarser level is made from them, never from
the rows. Sketches have a fixed size, so a level costs a row per cell whatever the cells hold.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Logarithm of the registers of a distinct-count sketch, and its relative error at three standard deviations.
LOG_REGISTERS = 12
DISTINCT_ERROR = 3 * 1.04 / math.sqrt(1 << LOG_REGISTERS)
#: Size of a quantile sketch, and its error in rank, as a share of all values (99 % sure).
QUANTILE_SIZE, RANK_ERROR = 200, 0.0165


def sketch_cells(df: DataFrame, by: Sequence[str], distinct: str, value: str) -> DataFrame:
    """Per cell: ``rows``, and sketches of its distinct ``distinct`` and of the distribution of ``value``.

    Nulls in either column are in no sketch, a null key is a cell. Without any value a sketch is empty.
    """
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(distinct, LOG_REGISTERS).alias("distinct_sketch"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), QUANTILE_SIZE).alias("value_sketch"),
    )


def merge_cells(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """The cells of a coarser level, from those of a finer one."""
    return cells.groupBy(*by).agg(
        F.sum("rows").alias("rows"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch").alias("value_sketch")
    )


def distinct_estimate() -> Column:
    """About how many distinct values, within ``DISTINCT_ERROR``."""
    return F.hll_sketch_estimate("distinct_sketch")


def quantile_estimate(p: float) -> Column:
    """A value whose rank is within ``RANK_ERROR`` of ``p``; null without values."""
    empty = F.kll_sketch_get_n_double("value_sketch") == 0
    return F.when(~empty, F.kll_sketch_get_quantile_double(F.col("value_sketch"), F.lit(float(p))))
