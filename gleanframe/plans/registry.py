"""The query registry."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

MODULES = ("scans", "relational", "mention_queries", "survey_queries", "rule_queries", "geo_queries", "rank_queries", "model_queries")


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` and, where SQL can say it, its check."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def load_all() -> None:
    """Import every query module; safe to call again."""
    for m in MODULES:
        importlib.import_module(f"gleanframe.plans.{m}")
