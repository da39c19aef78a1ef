"""Null and rounding rules that differ from Spark's defaults."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def if_else(cond: Column, yes, no) -> Column:
    """Two-way choice in which an unknown condition gives an unknown result."""
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(cond.isNull(), F.lit(None)).when(cond, yes).otherwise(no)


def in_set(x: Column | str, values: Iterable) -> Column:
    """Membership that is false, never null, for a null value."""
    return F.coalesce(_col(x).isin(list(values)), F.lit(False))


def strict_sum(x: Column | str) -> Column:
    """Sum that is null as soon as one input is null."""
    x = _col(x)
    return F.when(F.count(F.lit(1)) == F.count(x), F.sum(x))


def half_even(x: Column | str, digits: int = 0) -> Column:
    """Round half to even."""
    return F.bround(_col(x), digits)


def ratio(part: Column | str, whole: Column | str, scale: float = 1.0) -> Column:
    """``scale * part / whole``; null for an empty whole."""
    return F.try_divide(F.lit(scale) * _col(part), _col(whole).cast("double"))


def closed_set(x: Column | str, levels: Iterable[str]) -> Column:
    """Values outside the declared levels become null."""
    x = _col(x)
    return F.when(x.isin(list(levels)), x)


def level_ordinal(x: Column | str, levels: Iterable[str]) -> Column:
    """1-based position of a value in the declared order; null outside it."""
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), _col(x))
    return F.when(pos > 0, pos.cast("int"))


def level_letter(x: Column | str, levels: Iterable[str]) -> Column:
    """Letter code A, B, C... by position in the declared order."""
    return F.char(F.lit(64) + level_ordinal(x, levels))


def recode(x: Column | str, mapping: dict[str, str], unknown: str = "keep") -> Column:
    """Dictionary relabel. ``unknown="keep"`` passes other values, ``"null"`` drops them."""
    x = _col(x)
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    found = F.try_element_at(F.create_map(*pairs), x)
    return F.coalesce(found, x) if unknown == "keep" else found


def recode_pattern(x: Column | str, rules: Iterable[tuple[str, str]], ignore_case: bool = False) -> Column:
    """First rule whose text occurs in the value wins; other values stay."""
    x = _col(x)
    hay = F.lower(x) if ignore_case else x
    out = None
    for needle, label in rules:
        hit = hay.contains(needle.lower() if ignore_case else needle)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return x if out is None else out.otherwise(x)


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Round for reports, with negative zero folded into zero."""
    return F.round(_col(x), digits) + F.lit(0.0)
