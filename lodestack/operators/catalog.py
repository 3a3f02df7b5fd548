"""Groups, documents and chunks as tables: listing, replacing, soft deletion and repairs.

Parquet has no UPDATE, so each change gives the table's next state as a
DataFrame, to be written to a new place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.arrays import clean_list
from lodestack.operators.filters import resolved_group_id


def latest_rows(df: DataFrame, key: str = "id", order: str = "updated_at") -> DataFrame:
    """Of each id the row with the latest ``order``; rows that were delivered again count once.

    Of rows of one time the one with the larger values counts, column by
    column, so the choice never hangs on the order of delivery.
    """
    ties = [F.desc_nulls_last(f.name) for f in df.schema if f.name not in (key, order) and f.dataType.typeName() not in ("map", "variant")]
    newest = Window.partitionBy(key).orderBy(F.desc_nulls_last(order), *ties)
    return df.filter(F.col(key).isNotNull()).withColumn("__nth", F.row_number().over(newest)).filter(F.col("__nth") == 1).drop("__nth")


def group_counts(groups: DataFrame, documents: DataFrame) -> DataFrame:
    """Per group all its documents and those that aren't deleted (group_id, documents, listed)."""
    counts = documents.groupBy("group_id").agg(F.count("*").alias("documents"), F.count_if(F.col("status") != "deleted").alias("listed"))
    return groups.select(F.col("id").alias("group_id")).join(counts, "group_id", "left").fillna(0, ["documents", "listed"])


def deletable_groups(groups: DataFrame, documents: DataFrame) -> DataFrame:
    """Groups without any document; deleted ones still count."""
    return groups.join(documents.select(F.col("group_id").alias("id")), "id", "left_anti")


def listed_documents(documents: DataFrame, group_id: str) -> DataFrame:
    return documents.filter((F.col("group_id") == group_id) & (F.col("status") != "deleted"))


def soft_delete(documents: DataFrame, chunks: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks after the deletion of ``doomed`` (id): states change, search columns go, rows stay. Deleting again changes nothing."""
    marked = doomed.select(F.col("id").alias("__id")).distinct()
    docs = documents.join(marked, F.col("id") == F.col("__id"), "left")
    fresh = F.col("__id").isNotNull() & (F.col("status") != "deleted")
    docs = docs.withColumn("deleted_at", F.when(fresh, F.current_timestamp()).otherwise(F.col("deleted_at"))).withColumn("status", F.when(fresh, "deleted").otherwise(F.col("status"))).drop("__id")
    parts = chunks.join(marked, F.col("doc_id") == F.col("__id"), "left")
    for column in ("embedding", "content_morph"):
        parts = parts.withColumn(column, F.when(F.col("__id").isNull(), F.col(column)))
    return docs, parts.drop("__id")


def replace_chunks(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The chunk table after its documents' chunks were made anew: theirs replace all that the documents had."""
    return stored.join(fresh.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def new_documents(records: DataFrame) -> DataFrame:
    """Records (group_id, filename, content_type, tag) as pending documents; ids that miss are made, empty tag lists become null."""
    tags = clean_list(F.col("tag"))
    return records.withColumn("group_id", resolved_group_id(F.col("group_id"))).withColumn("tag", F.when(F.size(tags) > 0, tags)).withColumn("id", F.uuid()).withColumn("status", F.lit("pending")).withColumn("created_at", F.current_timestamp())


def unique_names(df: DataFrame, name: str, order: list[str], key: str = "id") -> DataFrame:
    """``df`` with repeated names told apart: all but the first of a name get the start of their id appended.

    The first of each name is an aggregate, so a name that very many rows share
    never gathers in one task.
    """
    place = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in (*order, key)])  # nulls come first
    first = df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("__name")).agg(F.min(place).alias("__first"))
    joined = df.join(first, F.col(name) == F.col("__name"), "left")
    return joined.withColumn(name, F.when(place != F.col("__first"), F.concat(F.col(name), F.lit("-"), F.substring(key, 1, 8))).otherwise(F.col(name))).drop("__name", "__first")


def duplicate_slugs(groups: DataFrame) -> DataFrame:
    """Groups (id, slug, first_id) whose trimmed, lower-case slug an earlier group (by id) has already."""
    slug = F.lower(F.trim("slug"))
    named = groups.select("id", slug.alias("slug")).filter(F.col("slug").isNotNull() & (F.col("slug") != ""))
    return named.join(named.groupBy("slug").agg(F.min("id").alias("first_id")), "slug").filter(F.col("id") != F.col("first_id")).select("id", "slug", "first_id")


def backfill_groups(documents: DataFrame, groups: DataFrame, tenant: str, default: str) -> DataFrame:
    """Documents with the group whose slug is their tenant's name, else the default group."""
    names = groups.filter(F.col("slug").isNotNull()).groupBy(F.col("slug").alias(tenant)).agg(F.min("id").alias("__group"))
    return documents.drop("group_id").join(names, tenant, "left").withColumn("group_id", F.coalesce("__group", F.lit(default))).drop("__group")


def tag_as_list(tag):
    """A single tag as a list of one; null stays null."""
    return F.when(tag.isNotNull(), F.array(tag))


def first_tag(tags):
    """The way back: the first of a list, null for none."""
    return F.when(F.size(tags) > 0, F.element_at(tags, 1))


def broken_links(chunks: DataFrame, documents: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (kind, id) that point nowhere: chunks without document, documents without group, rows without parent."""
    kinds = [
        ("chunk_document", chunks.select("id", F.col("doc_id").alias("ref")), documents),
        ("document_group", documents.select("id", F.col("group_id").alias("ref")), groups),
        ("chunk_parent", chunks.filter(F.col("parent_chunk_id").isNotNull()).select("id", F.col("parent_chunk_id").alias("ref")), chunks),
    ]
    found = [rows.join(to.select(F.col("id").alias("ref")), "ref", "left_anti").select(F.lit(kind).alias("kind"), "id") for kind, rows, to in kinds]
    return found[0].unionByName(found[1]).unionByName(found[2]).distinct()
