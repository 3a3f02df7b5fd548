"""Predicates on chunks and documents; each becomes part of the scan's filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.arrays import clean_list, contains_all
from lodestack.schema import GROUP_ID

__all__ = ["by_group", "by_tags", "completed", "group_id_problem", "resolved_group_id", "searchable_dense", "searchable_sparse", "clean_list"]


def completed(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("status") == "completed")


def by_group(df: DataFrame, group_id: str | None) -> DataFrame:
    """Rows of one group; None means all."""
    return df if group_id is None else df.filter(F.col("group_id") == group_id.strip())


def by_tags(documents: DataFrame, tags: list[str] | str | None) -> DataFrame:
    """Documents that have every tag."""
    wanted = [tags] if isinstance(tags, str) else list(tags or [])
    return documents.filter(contains_all(F.col("tag"), wanted))


def searchable_dense(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("embedding").isNotNull())


def searchable_sparse(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("content_morph").isNotNull())


def group_id_problem(group_id: Column) -> Column:
    """What is wrong with a group id: 'missing', 'malformed' or null."""
    gid = F.trim(group_id)
    return F.when(gid.isNull() | (gid == ""), "missing").when(~gid.rlike(GROUP_ID), "malformed")


def resolved_group_id(group_id: Column) -> Column:
    """The trimmed id, or a new one where there is none."""
    gid = F.trim(group_id)
    return F.when(gid.isNull() | (gid == ""), F.uuid()).otherwise(gid)
