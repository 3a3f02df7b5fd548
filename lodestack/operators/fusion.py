"""Combining, reranking and expanding ranked lists, for batches of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.text import Analyzer, words
from lodestack.sources.models import Scorer, coverage_scorer, score_pairs


def reciprocal_rank_fusion(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """One row (qid, key, rrf_score, rank) per entry of any list (qid, key, rank).

    Blank keys are skipped. Equal scores keep the order of first sight: the
    earlier list first, then the better rank.
    """
    tagged = [one.select("qid", key, "rank").withColumn("src", F.lit(i)) for i, one in enumerate(lists)]
    every = tagged[0]
    for more in tagged[1:]:
        every = every.unionByName(more)
    every = every.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    fused = every.groupBy("qid", key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf_score"), F.min(F.struct("src", "rank")).alias("seen"))
    best = Window.partitionBy("qid").orderBy(F.desc("rrf_score"), "seen.src", "seen.rank")
    return fused.withColumn("rank", F.row_number().over(best).cast("bigint")).drop("seen")


def term_coverage(query: Column, content: Column, analyzer: Analyzer = words) -> Column:
    """Share of the query's distinct terms that the content has: the default reranking score, a stand-in for a cross-encoder."""
    asked = F.array_distinct(analyzer(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, analyzer(content))), F.size(asked)), F.lit(0.0))


def rerank(hits: DataFrame, top_n: int, input_k: int = 50, chars: int | None = None, scorer: Callable[[Column, Column], Column] = term_coverage) -> DataFrame:
    """Hits (qid, query, content, rank, ...) with ``rerank_score`` and a new ``rank``; the first ``input_k`` are scored, equal scores keep their order.

    Whole texts are scored; ``chars`` cuts them for external models that take no more.
    """
    content = F.col("content") if chars is None else F.substring("content", 1, chars)
    scored = hits.filter(F.col("rank") <= input_k).withColumn("rerank_score", F.round(scorer(F.col("query"), content), 6))
    return _reranked(scored, top_n)


def rerank_by_model(hits: DataFrame, top_n: int, factory: Callable[[], Scorer] = coverage_scorer, input_k: int = 50, batch: int = 16, chars: int = 4000) -> DataFrame:
    """The same by a model that takes batches of (query, text) pairs; its texts are cut at ``chars``."""
    scored = score_pairs(hits.filter(F.col("rank") <= input_k), "query", "content", factory, batch, chars)
    return _reranked(scored.withColumn("rerank_score", F.round("rerank_score", 6)), top_n)


def _reranked(scored: DataFrame, top_n: int) -> DataFrame:
    best = Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "rank")
    return scored.withColumn("rank", F.row_number().over(best).cast("bigint")).filter(F.col("rank") <= top_n)


def nearest_table(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """``rows`` (chunk_id, doc_id, chunk_index, ...) with ``table_id``: the closest table before each in its document.

    One window over the document in reading order, not a range join: tables and
    rows are merged and the last table seen is carried forward.
    """
    tables = chunks.filter(F.col("type").isin("table", "table_text")).select("doc_id", "chunk_index", F.col("id").alias("__table"))
    both = rows.withColumn("__table", F.lit(None).cast("string")).unionByName(tables, allowMissingColumns=True)
    before = Window.partitionBy("doc_id").orderBy("chunk_index").rangeBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("table_id", F.last("__table", True).over(before))
    return seen.filter(F.col("__table").isNull() & F.col("chunk_id").isNotNull()).drop("__table")


def expand_to_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Hits (qid, chunk_id, content, type, parent_chunk_id, rank, ...) with table rows replaced by their table.

    ``parents`` has (id, content). The best row of a table wins and keeps its
    score; rows without a parent stay; ranks are given anew.
    """
    parent = parents.select(F.col("id").alias("__parent"), F.coalesce("content", F.lit("")).alias("__content"))
    joined = hits.join(parent, (F.col("type") == "table_row") & (F.col("parent_chunk_id") == F.col("__parent")), "left")
    lifted = F.col("__parent").isNotNull()
    slot = F.when(lifted, F.concat(F.lit("p:"), "__parent")).otherwise(F.concat(F.lit("c:"), F.col("rank").cast("string")))
    first = Window.partitionBy("qid", "__slot").orderBy("rank")
    once = joined.withColumn("__slot", slot).withColumn("__nth", F.row_number().over(first)).filter(F.col("__nth") == 1)
    swapped = (
        once.withColumn("chunk_id", F.when(lifted, F.col("__parent")).otherwise(F.col("chunk_id")))
        .withColumn("content", F.when(lifted, F.col("__content")).otherwise(F.col("content")))
        .withColumn("type", F.when(lifted, F.lit("table")).otherwise(F.col("type")))
        .withColumn("parent_chunk_id", F.when(lifted, F.lit(None)).otherwise(F.col("parent_chunk_id")))
    )
    again = Window.partitionBy("qid").orderBy("rank")
    return swapped.withColumn("rank", F.row_number().over(again).cast("bigint")).drop("__parent", "__content", "__slot", "__nth")


def final_score(*columns: str) -> Column:
    """The first score that there is: reranked before fused before raw."""
    return F.coalesce(*map(F.col, columns))
