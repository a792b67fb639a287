"""The engine's named queries and their SQL."""

from __future__ import annotations

from . import comparison, construction, ordered, policies, ranking, relational, reports, scoring, textual

MODULES = [scoring, policies, ranking, ordered, relational, textual, reports, comparison, construction]


def queries() -> dict:
    return {name: q for m in MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql is not None}
