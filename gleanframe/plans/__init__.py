"""Registered queries: each pairs a Spark plan with the SQL that checks it."""

from __future__ import annotations

from gleanframe.plans.registry import QUERIES, ORACLES, load_all

__all__ = ["QUERIES", "ORACLES", "load_all"]
