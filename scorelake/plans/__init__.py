"""All registered queries and their comparison SQL."""

from __future__ import annotations

from . import columns, formats, ordered, runs, scoring, telemetry, vectors
from .catalog import Query

_MODULES = (vectors, columns, runs, ordered, telemetry, scoring, formats)


def all_queries() -> dict[str, Query]:
    return {name: fn for m in _MODULES for name, fn in m.catalog.queries.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.catalog.sql.items()}
