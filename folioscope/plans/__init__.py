"""Registered queries: each a plan over the driver tables, with SQL that an independent engine can check where possible."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a plan under its function's name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


from folioscope.plans import documents, edits, history, library, lineage, linking, review, search, sequence, teaching, text  # noqa: E402, F401
