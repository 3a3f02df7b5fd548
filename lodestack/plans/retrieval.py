"""Queries of dense, sparse and hybrid retrieval, expansion and context, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.config import DEFAULTS
from lodestack.functions import text as T
from lodestack.operators import context, dense, filters, fusion, sparse
from lodestack.session import table

from .common import CHUNK, DOC, FIFTIETH, TOKENS, WORDS, chunks, documents, fiftieth

# ------------------------------------------------------------------- dense


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), "embedding")


def dense_knn(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    query = vectors.filter(F.col("vec_id") == 0).select(F.col("vec_id").alias("qid"), "embedding")
    return dense.knn(query, vectors, 10, key="vec_id").select("vec_id", "score", "rank")


def dense_knn_batch(spark, sf_dir):
    return dense.knn(_asked(spark, sf_dir), table(spark, sf_dir, "embeddings"), 5, key="vec_id", exclude_self=True)


def dense_filtered_label(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").filter(F.col("label") == 3)
    return dense.knn(_asked(spark, sf_dir), vectors, 5, key="vec_id")


def dense_chunks(spark, sf_dir):
    """Search among the chunks of completed documents, as hits with their file names; queries are the vectors of the stated query set."""
    stored = filters.searchable_dense(chunks(spark, sf_dir, "id", "doc_id", "chunk_index", "page", "type", "embedding"))
    live = filters.completed(documents(spark, sf_dir, "filename", "status")).select(F.col("id").alias("doc_id"), "filename")
    stored = stored.join(live, "doc_id")
    query = stored.filter((F.size("embedding") == 96) & fiftieth(F.col("id"))).select(F.col("id").alias("qid"), "embedding")
    hits = dense.knn(query, stored, DEFAULTS.dense_k)
    named = hits.join(stored.drop("embedding"), "id")
    return named.select("qid", F.col("id").alias("chunk_id"), "doc_id", F.coalesce("filename", F.lit("")).alias("filename"), "page", F.coalesce("type", F.lit("")).alias("type"), "chunk_index", "score", "rank")


def ann_lsh(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return dense.lsh_candidates(_asked(spark, sf_dir), vectors.select("vec_id", "embedding"), 5, key="vec_id", exclude_self=True)


def _knn_sql(k: int, stored: str = "embeddings", where: str = "true") -> str:
    return f"""SELECT q.vec_id AS qid, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank
        FROM embeddings q JOIN {stored} e ON {where} WHERE q.vec_id % 50 = 0 QUALIFY rank <= {k}"""


# ------------------------------------------------------------------ sparse


def token_stats(spark, sf_dir):
    terms = T.words(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(terms).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(terms)).cast("bigint").alias("n_distinct"))


def postings_df(spark, sf_dir):
    index = sparse.postings(table(spark, sf_dir, "documents"), "doc_id", "text")
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _chunk_texts(spark, sf_dir):
    return chunks(spark, sf_dir, "id", "content").withColumnRenamed("id", "chunk_id")


def _chunk_index(spark, sf_dir, terms):
    return sparse.index_for(terms, _chunk_texts(spark, sf_dir), "chunk_id", "content")


def _term_queries(spark, sf_dir):
    return sparse.query_terms(table(spark, sf_dir, "glossary_term").filter("enabled"), "id", "standard_term")


def sparse_and(spark, sf_dir):
    """Chunks that have every word of a standard term, for all enabled terms at once."""
    terms = _term_queries(spark, sf_dir)
    return sparse.boolean_match(terms, _chunk_index(spark, sf_dir, terms), "chunk_id")


def sparse_or_group(spark, sf_dir):
    """Matches of each enabled term with its synonyms' words as one group, counted per term."""
    terms = table(spark, sf_dir, "glossary_term").filter("enabled")
    names = F.concat(F.array("standard_term"), F.coalesce("synonyms", F.array().cast("array<string>")))
    grouped = terms.select(F.col("id").alias("qid"), F.lit(0).alias("grp"), F.explode(F.array_distinct(F.flatten(F.transform(names, T.words)))).alias("term"))
    return sparse.boolean_match(grouped, _chunk_index(spark, sf_dir, grouped), "chunk_id").groupBy("qid").agg(F.count("*").alias("n_chunks"))


def sparse_bm25(spark, sf_dir):
    """The best 10 chunks that share any word with a standard term."""
    terms = _term_queries(spark, sf_dir)
    return sparse.bm25(terms, _chunk_index(spark, sf_dir, terms), sparse.totals(_chunk_texts(spark, sf_dir), "content"), "chunk_id", k=10)


_CHUNK_TERMS = f"{CHUNK}, idx AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT id AS chunk_id, unnest({WORDS.format('content')}) AS term FROM chunk) GROUP BY 1, 2)"
_ASKED_TERMS = f"asked AS (SELECT DISTINCT id AS qid, unnest({WORDS.format('standard_term')}) AS term FROM glossary_term WHERE enabled)"


def _bm25_sql(key: str, k: int | None = None, matched: str = "") -> str:
    return f"""lens AS (SELECT {key}, sum(tf) AS len FROM idx GROUP BY 1), tot AS (SELECT count(*) AS n, avg(len) AS avg_len FROM lens),
        dfs AS (SELECT term, count(*) AS df FROM idx GROUP BY 1),
        scored AS (SELECT qid, {key}, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 6) AS score
          FROM asked JOIN dfs USING (term) JOIN idx USING (term) JOIN lens USING ({key}) {matched}, tot GROUP BY 1, 2),
        ranked AS (SELECT qid, {key}, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, {key}) AS rank FROM scored {'QUALIFY rank <= ' + str(k) if k else ''})"""


# ------------------------------------------------------------------ hybrid


def _hybrid_lists(spark, sf_dir):
    """Dense and sparse lists for the stated query set: a query is a vector with the first 8 words of its document.

    The sparse list ranks the documents that have every word of the query.
    """
    vectors = table(spark, sf_dir, "embeddings")
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = vectors.select(F.col("vec_id").alias("doc_id"), "embedding")
    near = dense.knn(_asked(spark, sf_dir), stored, DEFAULTS.dense_k, key="doc_id")
    asked = _asked(spark, sf_dir).select(F.col("qid").alias("doc_id")).join(texts, "doc_id")
    asked = asked.select(F.col("doc_id").alias("qid"), F.array_join(F.slice(T.words(F.col("text")), 1, 8), " ").alias("query"))
    terms = sparse.query_terms(asked, "qid", "query")
    worded = sparse.search(terms, texts, "doc_id", "text", DEFAULTS.sparse_k)
    return near, worded, asked, texts


def mode_dense(spark, sf_dir):
    return _hybrid_lists(spark, sf_dir)[0]


def mode_sparse(spark, sf_dir):
    return _hybrid_lists(spark, sf_dir)[1]


def rrf_fuse(spark, sf_dir):
    near, worded, _, _ = _hybrid_lists(spark, sf_dir)
    return fusion.reciprocal_rank_fusion([near, worded], "doc_id", DEFAULTS.rrf_k)


def rrf_single_source(spark, sf_dir):
    return fusion.reciprocal_rank_fusion([_hybrid_lists(spark, sf_dir)[1]], "doc_id", DEFAULTS.rrf_k)


def hybrid_topk(spark, sf_dir):
    """The flagship: both lists fused, the best 10 with a snippet and the score that counts."""
    near, worded, _, texts = _hybrid_lists(spark, sf_dir)
    fused = fusion.reciprocal_rank_fusion([near, worded], "doc_id", DEFAULTS.rrf_k).filter(F.col("rank") <= 10)
    named = fused.join(texts, "doc_id", "left")
    return named.select("qid", "doc_id", F.col("rrf_score").alias("score"), "rank", T.snippet(F.coalesce("text", F.lit("")), DEFAULTS.snippet_chars).alias("snippet"))


def no_rerank_topn(spark, sf_dir):
    return rrf_fuse(spark, sf_dir).filter(F.col("rank") <= DEFAULTS.rerank_top_n)


def rerank_topn(spark, sf_dir):
    """The fused list reranked by the share of query words that a text has."""
    near, worded, asked, texts = _hybrid_lists(spark, sf_dir)
    fused = fusion.reciprocal_rank_fusion([near, worded], "doc_id", DEFAULTS.rrf_k)
    hits = fused.join(asked, "qid").join(texts.withColumnRenamed("text", "content"), "doc_id")
    best = fusion.rerank(hits, DEFAULTS.rerank_top_n, DEFAULTS.rerank_input_k)
    return best.select("qid", "doc_id", fusion.final_score("rerank_score", "rrf_score").alias("score"), "rank")


def rerank_model(spark, sf_dir):
    """The same through the seam for batched models, whose texts are cut at 4,000 characters."""
    near, worded, asked, texts = _hybrid_lists(spark, sf_dir)
    fused = fusion.reciprocal_rank_fusion([near, worded], "doc_id", DEFAULTS.rrf_k)
    hits = fused.join(asked, "qid").join(texts.withColumnRenamed("text", "content"), "doc_id")
    best = fusion.rerank_by_model(hits, DEFAULTS.rerank_top_n, input_k=DEFAULTS.rerank_input_k, chars=DEFAULTS.rerank_chars)
    return best.select("qid", "doc_id", F.col("rerank_score").alias("score"), "rank")


_LISTS = f"""idx AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents) GROUP BY 1, 2),
    query AS (SELECT doc_id AS qid, list_slice({WORDS.format('text')}, 1, 8) AS w FROM documents JOIN embeddings ON vec_id = doc_id WHERE vec_id % 50 = 0),
    asked AS (SELECT DISTINCT qid, unnest(w) AS term FROM query),
    near AS (SELECT qid, vec_id AS doc_id, score, rank FROM ({_knn_sql(50)})), need AS (SELECT qid, count(*) AS needed FROM asked GROUP BY 1),
    met AS (SELECT qid, doc_id FROM asked JOIN idx USING (term) JOIN need USING (qid) GROUP BY qid, doc_id, needed HAVING count(*) = needed), {_bm25_sql('doc_id', 50, 'JOIN met USING (qid, doc_id)')}"""
_FUSED = """fused AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf_score, min(src * 1000000 + rank) AS seen
    FROM (SELECT 0 AS src, qid, doc_id, rank FROM near UNION ALL SELECT 1, qid, doc_id, rank FROM ranked) GROUP BY 1, 2),
    best AS (SELECT qid, doc_id, rrf_score, row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, seen) AS rank FROM fused)"""
_SNIPPET = "CASE WHEN length(coalesce({0}, '')) > 300 THEN substring({0}, 1, 300) || '...' ELSE coalesce({0}, '') END"


# ------------------------------------------------------- expansion, context


def _document_hits(spark, sf_dir):
    """Each document's chunks in reading order, as a ranked list of hits."""
    rows = chunks(spark, sf_dir, "id", "doc_id", "chunk_index", "content", "page", "type", "parent_chunk_id")
    return rows.select(F.col("doc_id").alias("qid"), F.col("id").alias("chunk_id"), "doc_id", "chunk_index", "content", "page", "type", "parent_chunk_id", (F.col("chunk_index") + 1).cast("bigint").alias("rank"))


def expand_parent(spark, sf_dir):
    parents = chunks(spark, sf_dir, "id", "content")
    return fusion.expand_to_parents(_document_hits(spark, sf_dir), parents).select("qid", "chunk_id", "type", "content", "rank")


def nearest_preceding(spark, sf_dir):
    hits = _document_hits(spark, sf_dir).filter(F.col("type") == "table_row").select("chunk_id", "doc_id", "chunk_index")
    return fusion.nearest_table(hits, chunks(spark, sf_dir, "id", "doc_id", "chunk_index", "type")).select("chunk_id", "table_id")


def _cited(spark, sf_dir):
    live = filters.completed(documents(spark, sf_dir, "filename", "status")).select(F.col("id").alias("doc_id"), "filename")
    hits = _document_hits(spark, sf_dir).join(live, "doc_id").withColumn("score", 1.0 / F.col("rank"))
    return context.citations(hits, content=True, chars=DEFAULTS.snippet_chars)


def citation_rank(spark, sf_dir):
    return _cited(spark, sf_dir).select("qid", "chunk_id", "filename", "page", F.round("score", 6).alias("score"), "rank", "snippet")


def citation_contexts(spark, sf_dir):
    """What an evaluation judges of each completed document: its citations' contents, else their snippets."""
    return context.contexts(_cited(spark, sf_dir))


def context_budget(spark, sf_dir):
    return context.budgeted(_cited(spark, sf_dir), 512).select("qid", "rank", "header", "kept_tokens", "body")


def fallback_answer(spark, sf_dir):
    """The context of each completed document and the answer that is given without a language model."""
    made = context.assembled(context.budgeted(_cited(spark, sf_dir), 512))
    return context.answered(made.withColumn("query", F.col("qid"))).select("qid", "context", "answer")


_CITED = f"""{CHUNK}, {DOC}, cited AS (SELECT c.doc_id AS qid, c.id AS chunk_id, coalesce(filename, '') AS filename, c.page AS page, round(1.0::DOUBLE / (c.chunk_index + 1), 6) AS score,
    row_number() OVER (PARTITION BY c.doc_id ORDER BY c.chunk_index) AS rank, coalesce(content, '') AS content FROM chunk c JOIN doc d ON d.id = c.doc_id WHERE d.status = 'completed')"""
_BUDGET = f"""{_CITED}, headed AS (SELECT *, '[' || rank || '] Source: ' || filename || CASE WHEN page > 0 THEN ' (page ' || page || ')' ELSE '' END AS header FROM cited),
    sized AS (SELECT *, {TOKENS.format('header')} AS h, {TOKENS.format('content')} AS b FROM headed),
    summed AS (SELECT *, coalesce(sum(h + b) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM sized),
    fit AS (SELECT qid, rank, header, least(b, 512 - used - h)::BIGINT AS kept_tokens, CASE WHEN b <= 512 - used - h THEN content ELSE
      array_to_string(list_slice(string_split(regexp_replace(content, '([\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}])', '\\1' || chr(1), 'g'), chr(1)), 1, (512 - used - h)::BIGINT), '') END AS body FROM summed WHERE used + h < 512)"""


def queries():
    found = [dense_knn, dense_knn_batch, dense_filtered_label, dense_chunks, ann_lsh, token_stats, postings_df, sparse_and, sparse_or_group, sparse_bm25, mode_dense, mode_sparse, rrf_fuse]
    found += [rrf_single_source, hybrid_topk, no_rerank_topn, rerank_topn, rerank_model, expand_parent, nearest_preceding, citation_rank, citation_contexts, context_budget, fallback_answer]
    return {f.__name__: f for f in found}


def oracle_sql():
    cover = "round(len(list_filter(list_distinct(q.w), lambda x: list_contains({0}, x)))::DOUBLE / nullif(len(list_distinct(q.w)), 0), 6)"
    reranked = """WITH {0}, s AS (SELECT b.qid, b.doc_id, coalesce({1}, 0.0) AS score, b.rank AS old FROM best b JOIN query q USING (qid) JOIN documents d USING (doc_id) WHERE b.rank <= 50)
            SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, old) AS rank FROM s QUALIFY rank <= 5"""
    fused = f"{_LISTS}, {_FUSED}"
    return {
        "dense_knn": """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
            s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM q)), 6) AS score FROM embeddings)
            SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10""",
        "dense_knn_batch": _knn_sql(5, where="q.vec_id <> e.vec_id"),
        "dense_filtered_label": _knn_sql(5, where="e.label = 3"),
        "dense_chunks": f"""WITH {CHUNK}, {DOC}, s AS (SELECT c.*, d.filename FROM chunk c JOIN doc d ON d.id = c.doc_id WHERE d.status = 'completed' AND len(embedding) = 96),
            q AS (SELECT id AS qid, embedding::DOUBLE[] AS v FROM s WHERE {FIFTIETH.format('id')}), r AS (SELECT s.*, qid, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM s, q)
            SELECT qid, id AS chunk_id, doc_id, coalesce(filename, '') AS filename, page, coalesce(type, '') AS type, chunk_index, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank
            FROM r WHERE NOT isnan(score) AND score IS NOT NULL QUALIFY rank <= 50""",
        "token_stats": f"SELECT doc_id, len({WORDS.format('text')}) AS n_tokens, len(list_distinct({WORDS.format('text')})) AS n_distinct FROM documents",
        "postings_df": f"""WITH t AS (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents)
            SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term""",
        "sparse_and": f"""WITH {_CHUNK_TERMS}, {_ASKED_TERMS}, need AS (SELECT qid, count(*) AS needed FROM asked GROUP BY 1)
            SELECT qid, chunk_id FROM asked JOIN idx USING (term) JOIN need USING (qid) GROUP BY qid, chunk_id, needed HAVING count(*) = needed""",
        "sparse_or_group": f"""WITH {_CHUNK_TERMS}, names AS (SELECT id AS qid, unnest(list_prepend(standard_term, coalesce(synonyms, []))) AS name FROM glossary_term WHERE enabled),
            asked AS (SELECT DISTINCT qid, unnest({WORDS.format('name')}) AS term FROM names) SELECT qid, count(DISTINCT chunk_id) AS n_chunks FROM asked JOIN idx USING (term) GROUP BY qid""",
        "sparse_bm25": f"WITH {_CHUNK_TERMS}, {_ASKED_TERMS}, {_bm25_sql('chunk_id', 10)} SELECT qid, chunk_id, score, rank FROM ranked",
        "mode_dense": f"SELECT qid, vec_id AS doc_id, score, rank FROM ({_knn_sql(50)})",
        "mode_sparse": f"WITH {_LISTS} SELECT qid, doc_id, score, rank FROM ranked",
        "rrf_fuse": f"WITH {_LISTS}, {_FUSED} SELECT qid, doc_id, rrf_score, rank FROM best",
        "rrf_single_source": f"WITH {_LISTS} SELECT qid, doc_id, round(1.0::DOUBLE / (60 + rank), 9) AS rrf_score, rank FROM ranked",
        "hybrid_topk": f"WITH {_LISTS}, {_FUSED} SELECT qid, doc_id, rrf_score AS score, rank, {_SNIPPET.format('text')} AS snippet FROM best LEFT JOIN documents USING (doc_id) WHERE rank <= 10",
        "no_rerank_topn": f"WITH {_LISTS}, {_FUSED} SELECT qid, doc_id, rrf_score, rank FROM best WHERE rank <= 5",
        "rerank_topn": reranked.format(fused, cover.format(WORDS.format("d.text"))),
        "rerank_model": reranked.format(fused, cover.format(WORDS.format("substring(d.text, 1, 4000)"))),
        "expand_parent": f"""WITH {CHUNK}, j AS (SELECT c.doc_id AS qid, c.id, c.type, c.content, c.chunk_index + 1 AS rank, p.id AS pid, coalesce(p.content, '') AS pcontent FROM chunk c LEFT JOIN chunk p ON c.type = 'table_row' AND c.parent_chunk_id = p.id),
            o AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY qid, coalesce('p:' || pid, 'c:' || rank) ORDER BY rank) = 1)
            SELECT qid, coalesce(pid, id) AS chunk_id, CASE WHEN pid IS NOT NULL THEN 'table' ELSE type END AS type, CASE WHEN pid IS NOT NULL THEN pcontent ELSE content END AS content, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM o""",
        "nearest_preceding": f"""WITH {CHUNK} SELECT r.id AS chunk_id, arg_max(t.id, t.chunk_index) AS table_id FROM chunk r LEFT JOIN chunk t
            ON t.doc_id = r.doc_id AND t.type IN ('table', 'table_text') AND t.chunk_index < r.chunk_index WHERE r.type = 'table_row' GROUP BY r.id""",
        "citation_rank": f"WITH {_CITED} SELECT qid, chunk_id, filename, page, score, rank, {_SNIPPET.format('content')} AS snippet FROM cited",
        "citation_contexts": f"""WITH {_CITED}, t AS (SELECT qid, rank, trim(content, chr(32) || chr(9) || chr(10) || chr(13)) AS context FROM cited)
            SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rank) - 1 AS pos, context FROM t WHERE context <> ''""",
        "context_budget": f"WITH {_BUDGET} SELECT qid, rank, header, kept_tokens, body FROM fit",
        "fallback_answer": f"""WITH {_BUDGET}, c AS (SELECT qid, string_agg(header || chr(10) || body || chr(10), chr(10) ORDER BY rank) AS context FROM fit GROUP BY qid)
            SELECT qid, context, 'Retrieved for: ' || qid || chr(10) || chr(10) || context || chr(10) || chr(10) || '(No language model is available.)' AS answer FROM c""",
    }
