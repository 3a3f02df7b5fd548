"""Citations, and a context for generation within a token budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import text as T


def citations(hits: DataFrame, snippet: bool = True, content: bool = False, chars: int = 300) -> DataFrame:
    """Hits (qid, chunk_id, doc_id, filename, page, score, rank, content) as citations, ranked 1..n; text fields only if wanted."""
    order = Window.partitionBy("qid").orderBy("rank")
    body = F.coalesce("content", F.lit(""))
    columns = [F.col("qid"), F.col("chunk_id"), F.col("doc_id"), F.coalesce("filename", F.lit("")).alias("filename"), F.col("page"), F.coalesce("score", F.lit(0.0)).alias("score")]
    columns += [F.row_number().over(order).cast("bigint").alias("rank")]
    columns += [T.snippet(body, chars).alias("snippet")] if snippet else []
    columns += [body.alias("content")] if content else []
    return hits.select(*columns)


def contexts(cited: DataFrame) -> DataFrame:
    """Citations (qid, rank, content, snippet) as the texts that an evaluation judges: (qid, pos, context), blank ones left out, counted from 0."""
    text = F.trim(F.coalesce(F.nullif("content", F.lit("")), "snippet", F.lit("")), F.lit(" \t\n\r"))
    order = Window.partitionBy("qid").orderBy("rank")
    kept = cited.select("qid", "rank", text.alias("context")).filter(F.col("context") != "")
    return kept.select("qid", (F.row_number().over(order) - 1).cast("bigint").alias("pos"), "context")


def budgeted(cited: DataFrame, limit: int, reserved: DataFrame | None = None, count: T.Counter = T.token_count) -> DataFrame:
    """Citations that fit ``limit`` tokens, with ``header``, ``kept_tokens`` and the ``body`` cut to them.

    The running sum decides: a citation is in while its header leaves room;
    the last one may be cut. ``reserved`` (qid, block) goes first if it is
    smaller than the limit.
    """
    page = F.when(F.col("page") > 0, F.concat(F.lit(" (page "), F.col("page").cast("string"), F.lit(")"))).otherwise("")
    rows = cited.withColumn("header", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] Source: "), "filename", page))
    if reserved is None:
        rows = rows.withColumn("block_tokens", F.lit(0))
    else:
        size = count(F.col("block"))
        rows = rows.join(reserved.select("qid", F.when(size < limit, size).otherwise(0).alias("block_tokens")), "qid", "left").fillna({"block_tokens": 0})
    rows = rows.withColumn("header_tokens", count(F.col("header"))).withColumn("body_tokens", count(F.col("content")))
    before = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.col("header_tokens") + F.col("body_tokens")).over(before), F.lit(0)) + F.col("block_tokens")
    rows = rows.withColumn("used", used).filter(F.col("used") + F.col("header_tokens") < limit)
    rows = rows.withColumn("kept_tokens", F.least(F.col("body_tokens"), F.lit(limit) - F.col("used") - F.col("header_tokens")).cast("bigint"))
    return rows.withColumn("body", T.truncate_tokens(F.col("content"), F.col("kept_tokens"))).drop("used", "block_tokens")


def assembled(fitting: DataFrame, reserved: DataFrame | None = None, limit: int | None = None, count: T.Counter = T.token_count) -> DataFrame:
    """One row (qid, context) per query; the glossary block, if any, comes first."""
    block = F.concat("header", F.lit("\n"), "body", F.lit("\n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("text")))), lambda x: x["text"]), "\n")
    made = fitting.groupBy("qid").agg(joined.alias("context"))
    if reserved is None:
        return made
    fits = F.lit(True) if limit is None else count(F.col("block")) < limit
    both = made.join(reserved.filter(fits).select("qid", "block"), "qid", "full_outer")
    return both.select("qid", F.concat_ws("\n", F.nullif("block", F.lit("")), "context").alias("context"))


def fallback_answer(query, context):
    """The answer without a language model, as a column."""
    none = F.lit("No answer can be written now: there is no language model and nothing was retrieved.")
    some = F.concat(F.lit("Retrieved for: "), query, F.lit("\n\n"), context, F.lit("\n\n(No language model is available.)"))
    return F.when(F.trim(F.coalesce(context, F.lit("")), F.lit(" \t\n\r")) == "", none).otherwise(some)


def answered(contexts: DataFrame, generate: Callable | None = None) -> DataFrame:
    """Contexts (qid, query, context) with ``answer``: by ``generate`` (two columns in, one out), else the fallback."""
    return contexts.withColumn("answer", (generate or fallback_answer)(F.col("query"), F.col("context")))
