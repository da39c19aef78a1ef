"""Operators for preparing text corpora, and their registered queries.

Nothing outside this subpackage imports it. ``QUERIES`` and ``ORACLES`` of
``gleanframe.llm.queries`` are added to the registry by ``__spark_entry__.py`` when the
subpackage is there.
"""
