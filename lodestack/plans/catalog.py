"""Queries of groups, documents and filters, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestack.functions.arrays import clean_list
from lodestack.operators import catalog, filters
from lodestack.session import table
from lodestack.sources import models

from .common import CHUNK, DOC, chunks, documents


def group_counts(spark, sf_dir):
    return catalog.group_counts(table(spark, sf_dir, "rag_group"), documents(spark, sf_dir, "group_id", "status"))


def empty_groups_anti(spark, sf_dir):
    return catalog.deletable_groups(table(spark, sf_dir, "rag_group"), documents(spark, sf_dir, "group_id")).select("id")


def group_filter(spark, sf_dir):
    """Documents of the group that has the most, by plain equality on the group."""
    docs = documents(spark, sf_dir, "group_id", "filename")
    top = docs.groupBy("group_id").count().orderBy(F.desc("count"), "group_id").first()
    return filters.by_group(docs, top["group_id"] if top else "").select("id", "group_id", "filename")


def tag_normalise(spark, sf_dir):
    return documents(spark, sf_dir, "tag").select("id", F.array_join(clean_list(F.col("tag")), "|").alias("tags"))


def tag_contains_all(spark, sf_dir):
    return filters.by_tags(documents(spark, sf_dir, "tag"), ["archive", " media ", "", "archive"]).select("id")


def completed_only(spark, sf_dir):
    return filters.completed(documents(spark, sf_dir, "status", "group_id")).select("id", "group_id")


def group_id_valid(spark, sf_dir):
    return table(spark, sf_dir, "rag_group").select("id", filters.group_id_problem(F.col("id")).alias("id_problem"), filters.group_id_problem(F.col("slug")).alias("slug_problem"))


def searchable_counts(spark, sf_dir):
    """Chunks per document that dense and sparse search can find."""
    rows = chunks(spark, sf_dir, "id", "doc_id", "embedding", "content_morph")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("embedding").isNotNull()).alias("n_dense"), F.count_if(F.col("content_morph").isNotNull()).alias("n_sparse"))


def soft_delete(spark, sf_dir):
    """States and searchable chunks after all failed documents are deleted."""
    docs = documents(spark, sf_dir, "status", "deleted_at")
    parts = chunks(spark, sf_dir, "id", "doc_id", "embedding", "content_morph")
    docs, parts = catalog.soft_delete(docs, parts, docs.filter(F.col("status") == "failed").select("id"))
    left = parts.groupBy("doc_id").agg(F.count_if(F.col("embedding").isNotNull()).alias("n_dense"))
    return docs.join(left, F.col("id") == F.col("doc_id"), "left").select("id", "status", F.col("deleted_at").isNotNull().alias("deleted"), F.coalesce("n_dense", F.lit(0).cast("bigint")).alias("n_dense"))


def dedupe_names_rownum(spark, sf_dir):
    docs = documents(spark, sf_dir, "filename", "created_at")
    return catalog.unique_names(docs, "filename", ["created_at"]).select("id", "filename")


def backfill_groups(spark, sf_dir):
    """Documents assigned anew by the slug of their group's name."""
    docs = documents(spark, sf_dir, "group_id").withColumn("tenant", F.lower(F.trim("group_id")))
    groups = table(spark, sf_dir, "rag_group").withColumn("slug", F.lower(F.trim("slug")))
    return catalog.backfill_groups(docs, groups, "tenant", "default").select("id", "group_id")


def tag_to_array(spark, sf_dir):
    """Each document's first tag as a scalar, and that as a list again."""
    one = documents(spark, sf_dir, "tag").select("id", catalog.first_tag(F.col("tag")).alias("tag"))
    return one.select("id", "tag", F.size(F.coalesce(catalog.tag_as_list(F.col("tag")), F.array().cast("array<string>"))).cast("bigint").alias("n"))


def broken_links(spark, sf_dir):
    return catalog.broken_links(chunks(spark, sf_dir, "id", "doc_id", "parent_chunk_id"), documents(spark, sf_dir, "group_id"), table(spark, sf_dir, "rag_group"))


def stale_counts(spark, sf_dir):
    """Documents whose stored number of chunks isn't that of their chunks."""
    counts = chunks(spark, sf_dir, "id", "doc_id").groupBy("doc_id").agg(F.count("*").alias("actual"))
    docs = documents(spark, sf_dir, "chunk_count").join(counts, F.col("id") == F.col("doc_id"), "left")
    actual = F.coalesce("actual", F.lit(0).cast("bigint"))
    return docs.select("id", F.col("chunk_count").cast("bigint").alias("stored"), actual.alias("actual")).filter(~F.col("stored").eqNullSafe(F.col("actual")))


def replace_chunks(spark, sf_dir):
    """The chunk table after the failed documents were made anew from their searchable chunks alone."""
    stored = chunks(spark, sf_dir, "id", "doc_id", "chunk_index", "content_morph")
    failed = documents(spark, sf_dir, "status").filter(F.col("status") == "failed").select(F.col("id").alias("doc_id"))
    fresh = stored.join(failed, "doc_id").filter(F.col("content_morph").isNotNull()).select(F.concat(F.lit("n-"), "id").alias("id"), "doc_id", "chunk_index")
    return catalog.replace_chunks(stored.drop("content_morph"), fresh).select("id", "doc_id", "chunk_index")


def new_documents(spark, sf_dir):
    """The failed documents uploaded again, as pending ones with ids of their own."""
    records = documents(spark, sf_dir, "group_id", "filename", "content_type", "tag", "status").filter(F.col("status") == "failed").withColumnRenamed("id", "old_id")
    made = catalog.new_documents(records)
    fresh = (F.col("id") != F.col("old_id")) & F.col("group_id").isNotNull() & F.col("created_at").isNotNull()
    return made.select("old_id", "filename", "content_type", F.array_join("tag", "|").alias("tags"), "status", fresh.alias("fresh"))


def duplicate_groups(spark, sf_dir):
    return catalog.duplicate_slugs(table(spark, sf_dir, "rag_group"))


def listed_documents(spark, sf_dir):
    """Every group's documents that aren't deleted, newest first, by number."""
    docs = documents(spark, sf_dir, "group_id", "filename", "status", "created_at").filter(F.col("status") != "deleted")
    order = Window.partitionBy("group_id").orderBy(F.desc_nulls_last("created_at"), "id")
    return docs.select("group_id", F.row_number().over(order).cast("bigint").alias("nth"), "id", "filename", "status")


def index_counts(spark, sf_dir):
    """Chunks that the index took and those without a usable vector."""
    return models.indexed(chunks(spark, sf_dir, "id", "embedding"), 96)


def queries():
    found = [group_counts, empty_groups_anti, group_filter, tag_normalise, tag_contains_all, completed_only, group_id_valid, searchable_counts, soft_delete]
    found += [dedupe_names_rownum, backfill_groups, tag_to_array, broken_links, stale_counts, replace_chunks, new_documents, duplicate_groups, listed_documents, index_counts]
    return {f.__name__: f for f in found}


def oracle_sql():
    problem = "CASE WHEN coalesce(trim({0}), '') = '' THEN 'missing' WHEN NOT regexp_full_match(trim({0}), '[A-Za-z0-9][A-Za-z0-9._:-]{{0,127}}') THEN 'malformed' END"
    clean = "list_filter(list_transform(coalesce(tag, []), lambda v: trim(v)), lambda v: v IS NOT NULL AND v <> '')"
    return {
        "group_counts": f"""WITH {DOC} SELECT g.id AS group_id, count(d.id) AS documents, count(d.id) FILTER (WHERE d.status <> 'deleted') AS listed FROM rag_group g LEFT JOIN doc d ON d.group_id = g.id GROUP BY 1""",
        "empty_groups_anti": f"WITH {DOC} SELECT id FROM rag_group g WHERE NOT EXISTS (SELECT 1 FROM doc d WHERE d.group_id = g.id)",
        "group_filter": f"WITH {DOC}, t AS (SELECT group_id FROM doc GROUP BY 1 ORDER BY count(*) DESC, group_id LIMIT 1) SELECT id, group_id, filename FROM doc WHERE group_id = (SELECT group_id FROM t)",
        "tag_normalise": f"""WITH {DOC}, c AS (SELECT id, {clean} AS ts FROM doc), p AS (SELECT id, unnest(ts) AS t, unnest(generate_series(1, len(ts))) AS i FROM c WHERE len(ts) > 0),
            f AS (SELECT id, t, min(i) AS i FROM p GROUP BY 1, 2), j AS (SELECT id, string_agg(t, '|' ORDER BY i) AS tags FROM f GROUP BY 1) SELECT c.id, coalesce(j.tags, '') AS tags FROM c LEFT JOIN j USING (id)""",
        "tag_contains_all": f"WITH {DOC} SELECT id FROM doc WHERE tag IS NOT NULL AND list_has_all(tag, ['archive', 'media'])",
        "completed_only": f"WITH {DOC} SELECT id, group_id FROM doc WHERE status = 'completed'",
        "group_id_valid": f"SELECT id, {problem.format('id')} AS id_problem, {problem.format('slug')} AS slug_problem FROM rag_group",
        "searchable_counts": f"WITH {CHUNK} SELECT doc_id, count(*) AS n, count(embedding) AS n_dense, count(content_morph) AS n_sparse FROM chunk GROUP BY 1",
        "soft_delete": f"""WITH {DOC}, {CHUNK}, l AS (SELECT doc_id, count(embedding) AS n_dense FROM chunk GROUP BY 1)
            SELECT d.id, CASE WHEN status = 'failed' THEN 'deleted' ELSE status END AS status, status = 'failed' OR deleted_at IS NOT NULL AS deleted, CASE WHEN status = 'failed' THEN 0 ELSE coalesce(n_dense, 0) END AS n_dense FROM doc d LEFT JOIN l ON l.doc_id = d.id""",
        "dedupe_names_rownum": f"""WITH {DOC} SELECT id, CASE WHEN filename IS NOT NULL AND row_number() OVER (PARTITION BY filename ORDER BY created_at NULLS FIRST, id) > 1 THEN filename || '-' || left(id, 8) ELSE filename END AS filename FROM doc""",
        "backfill_groups": f"""WITH {DOC}, g AS (SELECT lower(trim(slug)) AS slug, min(id) AS gid FROM rag_group WHERE slug IS NOT NULL GROUP BY 1)
            SELECT d.id, coalesce(g.gid, 'default') AS group_id FROM doc d LEFT JOIN g ON g.slug = lower(trim(d.group_id))""",
        "tag_to_array": f"WITH {DOC} SELECT id, tag[1] AS tag, CASE WHEN tag[1] IS NULL THEN 0 ELSE 1 END::BIGINT AS n FROM doc",
        "broken_links": f"""WITH {DOC}, {CHUNK} SELECT DISTINCT 'chunk_document' AS kind, id FROM chunk WHERE doc_id NOT IN (SELECT id FROM doc) OR doc_id IS NULL
            UNION SELECT 'document_group', id FROM doc WHERE group_id NOT IN (SELECT id FROM rag_group) OR group_id IS NULL
            UNION SELECT 'chunk_parent', id FROM chunk WHERE parent_chunk_id IS NOT NULL AND parent_chunk_id NOT IN (SELECT id FROM chunk)""",
        "replace_chunks": f"""WITH {DOC}, {CHUNK}, failed AS (SELECT id FROM doc WHERE status = 'failed'),
            fresh AS (SELECT 'n-' || id AS id, doc_id, chunk_index FROM chunk WHERE doc_id IN (SELECT id FROM failed) AND content_morph IS NOT NULL)
            SELECT id, doc_id, chunk_index FROM chunk WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM fresh) UNION ALL SELECT * FROM fresh""",
        "new_documents": f"""WITH {DOC}, c AS (SELECT id AS old_id, filename, content_type, {clean} AS ts FROM doc WHERE status = 'failed'),
            p AS (SELECT old_id, unnest(ts) AS t, unnest(generate_series(1, len(ts))) AS i FROM c WHERE len(ts) > 0), f AS (SELECT old_id, t, min(i) AS i FROM p GROUP BY 1, 2), j AS (SELECT old_id, string_agg(t, '|' ORDER BY i) AS tags FROM f GROUP BY 1)
            SELECT old_id, filename, content_type, tags, 'pending' AS status, true AS fresh FROM c LEFT JOIN j USING (old_id)""",
        "duplicate_groups": """WITH n AS (SELECT id, lower(trim(slug)) AS slug FROM rag_group WHERE trim(slug) <> ''), f AS (SELECT slug, min(id) AS first_id FROM n GROUP BY 1)
            SELECT id, slug, first_id FROM n JOIN f USING (slug) WHERE id <> first_id""",
        "listed_documents": f"WITH {DOC} SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY created_at DESC NULLS LAST, id) AS nth, id, filename, status FROM doc WHERE status <> 'deleted'",
        "index_counts": f"WITH {CHUNK} SELECT count(*) FILTER (WHERE coalesce(len(embedding), 0) = 96) AS success, count(*) FILTER (WHERE coalesce(len(embedding), 0) <> 96) AS errors FROM chunk",
        "stale_counts": f"""WITH {DOC}, {CHUNK}, c AS (SELECT doc_id, count(*) AS actual FROM chunk GROUP BY 1)
            SELECT d.id, d.chunk_count::BIGINT AS stored, coalesce(c.actual, 0) AS actual FROM doc d LEFT JOIN c ON c.doc_id = d.id WHERE d.chunk_count IS DISTINCT FROM coalesce(c.actual, 0)""",
    }
