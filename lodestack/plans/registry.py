"""The registered queries of the core operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog, evaluation, ingest, pipeline, retrieval, terms


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for module in (retrieval, pipeline, ingest, terms, evaluation, catalog):
        found |= module.queries()
    return found
