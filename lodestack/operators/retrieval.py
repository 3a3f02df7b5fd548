"""The whole retrieval of a batch of queries, and the context that a model answers from.

Glossary-expanded full-text search and exact vector search, fused, reranked,
table rows replaced by their tables, cited. Every stage is a DataFrame over all
queries at once. ``mode`` chooses the searches as the service does: only the
lists that it needs are made.

Defined results: queries without any hit have no rows; null and blank query
texts find nothing by words, null vectors nothing by similarity; of chunks and
documents only the latest state may be given; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.config import DEFAULTS, Settings
from lodestack.functions.text import Analyzer, words
from lodestack.operators import context, dense, filters, fusion, glossary, sparse

MODES = ("hybrid", "dense", "sparse")


def searchable(chunks: DataFrame, documents: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """Chunks of completed documents that have every tag, with their ``filename``."""
    live = filters.by_tags(filters.completed(documents), tags).select(F.col("id").alias("doc_id"), F.coalesce("filename", F.lit("")).alias("filename"))
    return chunks.withColumnRenamed("id", "chunk_id").join(live, "doc_id")


def boolean_queries(queries: DataFrame, terms: DataFrame | None, analyzer: Analyzer = words, charset: str | None = None) -> DataFrame:
    """Queries (qid, query) as boolean ones (qid, grp, term), expanded by the glossary ``terms`` if given."""
    if terms is None:
        return sparse.query_terms(queries, "qid", "query", analyzer).withColumn("grp", F.col("grp").cast("string"))
    known = glossary.surfaces(terms)
    return glossary.expanded_terms(glossary.segments(queries, known), known, analyzer, charset, queries)


def retrieve(
    queries: DataFrame, chunks: DataFrame, documents: DataFrame, terms: DataFrame | None = None, *, mode: str = "hybrid", rerank: bool = True,
    tags: list[str] | None = None, top_n: int | None = None, settings: Settings = DEFAULTS, analyzer: Analyzer = words,
) -> DataFrame:
    """Hits (qid, chunk_id, doc_id, filename, content, type, page, chunk_index, parent_chunk_id, score, rank) of each query.

    ``queries`` has (qid, query, group_id, embedding): a null group searches
    all. ``rank`` counts from 1 after the parents replaced their rows.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    stored = searchable(chunks, documents, tags)
    lists = []
    if mode != "sparse":
        vectors = filters.searchable_dense(stored).select("chunk_id", "embedding", "group_id")
        lists.append(dense.knn(queries, vectors, settings.dense_k, key="chunk_id", group="group_id").select("qid", "chunk_id", "rank"))
    if mode != "dense":
        texts = filters.searchable_sparse(stored).select("chunk_id", "content", "group_id")
        asked = boolean_queries(queries, terms, analyzer)
        lists.append(sparse.search(asked, texts, "chunk_id", "content", settings.sparse_k, analyzer, queries).select("qid", "chunk_id", "rank"))
    fused = fusion.reciprocal_rank_fusion(lists, "chunk_id", settings.rrf_k).filter(F.col("rank") <= settings.rerank_input_k)
    body = stored.select("chunk_id", "doc_id", "filename", "content", "type", "page", "chunk_index", "parent_chunk_id")
    hits = fused.join(body, "chunk_id").join(queries.select("qid", "query"), "qid")
    n = top_n or settings.rerank_top_n
    best = fusion.rerank(hits, n, settings.rerank_input_k) if rerank else hits.filter(F.col("rank") <= n).withColumn("rerank_score", F.lit(None).cast("double"))
    best = best.withColumn("score", fusion.final_score("rerank_score", "rrf_score")).drop("rerank_score", "rrf_score", "query")
    return fusion.expand_to_parents(best, chunks.select("id", "content"))


def answer(queries: DataFrame, hits: DataFrame, terms: DataFrame | None = None, limit: int | None = None, generate=None, settings: Settings = DEFAULTS) -> DataFrame:
    """One row (qid, context, answer) per query: the glossary's definitions first, then the cited hits within the token budget."""
    limit = limit or settings.context_max_tokens
    block = None
    if terms is not None:
        known = glossary.surfaces(terms)
        block = glossary.glossary_block(glossary.matched_definitions(glossary.segments(queries, known), known, glossary.definitions(terms)))
    cited = context.citations(hits, content=True, chars=settings.snippet_chars)
    made = context.assembled(context.budgeted(cited, limit, block), block, limit)
    asked = queries.select("qid", F.coalesce("query", F.lit("")).alias("query")).join(made, "qid", "left").withColumn("context", F.coalesce("context", F.lit("")))
    return context.answered(asked, generate).select("qid", "context", "answer")
