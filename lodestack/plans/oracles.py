"""SQL equivalents of the registered core queries."""

from __future__ import annotations

from . import catalog, evaluation, ingest, pipeline, retrieval, terms


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for module in (retrieval, pipeline, ingest, terms, evaluation, catalog):
        found |= module.oracle_sql()
    return found
