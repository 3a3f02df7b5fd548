"""Queries of full-text search and of the whole retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import context, retrieval, sparse
from lodestack.session import table

from . import terms as glossary_plans
from .common import CHUNK, DOC, FIFTIETH, TOKENS, WORDS, chunks, documents, fiftieth

#: Letters and digits that a stricter analyser keeps; other terms are dropped, and a query without any falls back to all its terms.
STRICT = "[0-9A-Za-z가-힣]+"


def _queries(spark, sf_dir):
    """The stated query set: a chunk's first 5 words and its vector; those at an odd place ask their own group only."""
    rows = chunks(spark, sf_dir, "id", "content", "embedding", "group_id", "chunk_index").filter(fiftieth(F.col("id")) & F.col("content").isNotNull())
    asked = F.array_join(F.slice(T.words(F.col("content")), 1, 5), " ")
    return rows.select(F.col("id").alias("qid"), asked.alias("query"), F.when(F.col("chunk_index") % 2 == 1, F.col("group_id")).alias("group_id"), "embedding")


def _stored(spark, sf_dir):
    rows = chunks(spark, sf_dir, "id", "doc_id", "group_id", "content", "content_morph", "type", "page", "chunk_index", "parent_chunk_id", "embedding")
    return rows, documents(spark, sf_dir, "filename", "status", "tag")


def fts_topk(spark, sf_dir):
    """Full-text search alone: glossary-expanded queries, whole matches, ranked, within the query's group."""
    asked = _queries(spark, sf_dir)
    rows, docs = _stored(spark, sf_dir)
    texts = retrieval.searchable(rows, docs).filter(F.col("content_morph").isNotNull()).select("chunk_id", "content", "group_id")
    terms = retrieval.boolean_queries(asked, table(spark, sf_dir, "glossary_term"))
    return sparse.search(terms, texts, "chunk_id", "content", 50, scope=asked)


def fts_tagged(spark, sf_dir):
    """The same among the documents with a tag, the glossary left out."""
    asked = _queries(spark, sf_dir)
    rows, docs = _stored(spark, sf_dir)
    texts = retrieval.searchable(rows, docs, ["archive"]).filter(F.col("content_morph").isNotNull()).select("chunk_id", "content", "group_id")
    return sparse.search(retrieval.boolean_queries(asked, None), texts, "chunk_id", "content", 50, scope=asked)


def fts_fallback(spark, sf_dir):
    """Boolean terms of all evaluation questions and corpus titles under the strict letters, with the fallback where none is left."""
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("qid"), F.get(T.words(F.col("text")), F.lit(0)).alias("query")).filter(F.col("query").isNotNull())
    empty = table(spark, sf_dir, "glossary_term").limit(0)
    made = retrieval.boolean_queries(asked, empty, charset=STRICT)
    return made.select("qid", F.col("grp").startswith("f.").alias("fallback"), "term")


def _hits(spark, sf_dir, **options):
    rows, docs = _stored(spark, sf_dir)
    asked = _queries(spark, sf_dir)
    return asked, retrieval.retrieve(asked, rows, docs, table(spark, sf_dir, "glossary_term"), **options)


def retrieve_topn(spark, sf_dir):
    """The whole retrieval: both searches, fused, reranked, expanded and cited."""
    return context.citations(_hits(spark, sf_dir)[1])


def retrieve_dense(spark, sf_dir):
    """The whole retrieval by vectors alone, without reranking."""
    return context.citations(_hits(spark, sf_dir, mode="dense", rerank=False)[1])


def answer_queries(spark, sf_dir):
    """The query service: the definitions that a query mentions, the cited hits within 300 tokens, and the answer that needs no model."""
    asked, hits = _hits(spark, sf_dir)
    return retrieval.answer(asked, hits, table(spark, sf_dir, "glossary_term"), 300)


def queries():
    found = [fts_topk, fts_tagged, fts_fallback, retrieve_topn, retrieve_dense, answer_queries]
    return {f.__name__: f for f in found}


_ASKED = f"""{CHUNK}, {DOC}, src AS (SELECT id AS qid, array_to_string(list_slice({WORDS.format('content')}, 1, 5), ' ') AS query, CASE WHEN chunk_index % 2 = 1 THEN group_id END AS grp_id, embedding
      FROM chunk WHERE content IS NOT NULL AND {FIFTIETH.format('id')}),
    live AS (SELECT c.*, coalesce(d.filename, '') AS filename, d.tag AS tag FROM chunk c JOIN doc d ON d.id = c.doc_id WHERE d.status = 'completed')"""
_PLAIN = f"terms AS (SELECT DISTINCT qid, x AS grp, x AS term FROM (SELECT qid, unnest({WORDS.format('query')}) AS x FROM src))"


def _search_sql(where: str = "true", k: int = 50) -> str:
    """The CTEs from ``terms`` (qid, grp, term) to ``ranked``."""
    return f"""texts AS (SELECT id AS chunk_id, content, group_id FROM live WHERE content_morph IS NOT NULL AND {where}),
        idx AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest({WORDS.format('content')}) AS term FROM texts) GROUP BY 1, 2),
        lens AS (SELECT chunk_id, sum(tf) AS len FROM idx GROUP BY 1), tot AS (SELECT count(*) AS n, avg(len) AS avg_len FROM lens), dfs AS (SELECT term, count(*) AS df FROM idx GROUP BY 1),
        need AS (SELECT qid, count(DISTINCT grp) AS needed FROM terms GROUP BY 1),
        met AS (SELECT qid, chunk_id FROM terms JOIN idx USING (term) JOIN need USING (qid) GROUP BY qid, chunk_id, needed HAVING count(DISTINCT grp) = needed),
        scoped AS (SELECT met.* FROM met JOIN src USING (qid) JOIN texts USING (chunk_id) WHERE grp_id IS NULL OR trim(grp_id) = group_id),
        scored AS (SELECT qid, chunk_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 6) AS score
          FROM (SELECT DISTINCT qid, term FROM terms) JOIN dfs USING (term) JOIN idx USING (term) JOIN lens USING (chunk_id) JOIN scoped USING (qid, chunk_id), tot GROUP BY 1, 2),
        ranked AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= {k})"""


_NEAR = """near AS (SELECT qid, chunk_id, rank FROM (SELECT q.qid, v.id AS chunk_id, row_number() OVER (PARTITION BY q.qid ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, v.id) AS rank
      FROM (SELECT * FROM src WHERE len(embedding) = 96 AND isfinite(list_sum(embedding)) AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0) q
      JOIN (SELECT * FROM live WHERE len(embedding) = 96 AND isfinite(list_sum(embedding)) AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0) v ON q.grp_id IS NULL OR trim(q.grp_id) = trim(v.group_id)) WHERE rank <= 50)"""


def _hits_sql(lists: str, rerank: bool) -> str:
    """The CTEs from rank lists (src, qid, chunk_id, rank) to ``hits``."""
    asked = "list_distinct(" + WORDS.format("query") + ")"
    cover = f"round(coalesce(len(list_filter({asked}, lambda x: list_contains({WORDS.format('content')}, x)))::DOUBLE / nullif(len({asked}), 0), 0.0), 6)"
    return f"""fused AS (SELECT qid, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, min(place * 1000000 + rank) AS seen FROM ({lists}) GROUP BY 1, 2),
        first AS (SELECT qid, chunk_id, rrf, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, seen) AS rank FROM fused QUALIFY rank <= 50),
        full_hits AS (SELECT f.qid, f.chunk_id, l.doc_id, filename, content, type, page, parent_chunk_id, f.rank AS old, {cover if rerank else 'rrf'} AS score FROM first f JOIN live l ON l.id = f.chunk_id JOIN src q ON q.qid = f.qid),
        top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {'score DESC, old' if rerank else 'old'}) AS rank FROM full_hits QUALIFY rank <= 5),
        lifted AS (SELECT t.*, p.id AS pid, coalesce(p.content, '') AS pcontent FROM top t LEFT JOIN chunk p ON t.type = 'table_row' AND t.parent_chunk_id = p.id),
        once AS (SELECT * FROM lifted QUALIFY row_number() OVER (PARTITION BY qid, coalesce('p:' || pid, 'c:' || rank) ORDER BY rank) = 1),
        hits AS (SELECT qid, coalesce(pid, chunk_id) AS chunk_id, doc_id, filename, page, score, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank, CASE WHEN pid IS NOT NULL THEN pcontent ELSE coalesce(content, '') END AS content FROM once)"""


_BOTH = "SELECT 0 AS place, qid, chunk_id, rank FROM near UNION ALL SELECT 1, qid, chunk_id, rank FROM ranked"
_CITED = "SELECT qid, chunk_id, doc_id, filename, page, score, rank, CASE WHEN length(content) > 300 THEN substring(content, 1, 300) || '...' ELSE content END AS snippet FROM hits"


def oracle_sql():
    expand = glossary_plans.expand_sql("src")
    budget = f"""headed AS (SELECT *, '[' || rank || '] Source: ' || filename || CASE WHEN page > 0 THEN ' (page ' || page || ')' ELSE '' END AS header FROM hits),
        blocks AS (SELECT qid, block, CASE WHEN {TOKENS.format('block')} < 300 THEN {TOKENS.format('block')} ELSE 0 END AS held FROM block),
        sized AS (SELECT h.*, coalesce(b.held, 0) AS held, {TOKENS.format('header')} AS h, {TOKENS.format('content')} AS b FROM headed h LEFT JOIN blocks b USING (qid)),
        summed AS (SELECT *, held + coalesce(sum(h + b) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM sized),
        fit AS (SELECT qid, rank, header, CASE WHEN b <= 300 - used - h THEN content ELSE
          array_to_string(list_slice(string_split(regexp_replace(content, '([\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}])', '\\1' || chr(1), 'g'), chr(1)), 1, (300 - used - h)::BIGINT), '') END AS body FROM summed WHERE used + h < 300),
        made AS (SELECT qid, string_agg(header || chr(10) || body || chr(10), chr(10) ORDER BY rank) AS body FROM fit GROUP BY 1),
        ctx AS (SELECT s.qid, s.query, coalesce(CASE WHEN b.held > 0 THEN CASE WHEN m.body IS NULL THEN b.block ELSE b.block || chr(10) || m.body END ELSE m.body END, '') AS context FROM src s LEFT JOIN blocks b USING (qid) LEFT JOIN made m USING (qid))
        SELECT qid, context, CASE WHEN trim(context, chr(32) || chr(10)) = '' THEN 'No answer can be written now: there is no language model and nothing was retrieved.'
          ELSE 'Retrieved for: ' || query || chr(10) || chr(10) || context || chr(10) || chr(10) || '(No language model is available.)' END AS answer FROM ctx"""
    first = WORDS.format("text")
    return {
        "fts_topk": f"WITH RECURSIVE {_ASKED}, {expand}, {_search_sql()} SELECT qid, chunk_id, score, rank FROM ranked",
        "fts_tagged": f"WITH {_ASKED}, {_PLAIN}, {_search_sql(where='''tag IS NOT NULL AND list_contains(tag, 'archive')''')} SELECT qid, chunk_id, score, rank FROM ranked",
        "fts_fallback": f"SELECT doc_id::VARCHAR AS qid, NOT regexp_full_match({first}[1], '{STRICT}') AS fallback, {first}[1] AS term FROM documents WHERE len({first}) > 0",
        "retrieve_topn": f"WITH RECURSIVE {_ASKED}, {expand}, {_search_sql()}, {_NEAR}, {_hits_sql(_BOTH, True)} {_CITED}",
        "retrieve_dense": f"WITH {_ASKED}, {_NEAR}, {_hits_sql('SELECT 0 AS place, qid, chunk_id, rank FROM near', False)} {_CITED}",
        "answer_queries": f"WITH RECURSIVE {_ASKED}, {expand}, {glossary_plans.block_sql()}, {_search_sql()}, {_NEAR}, {_hits_sql(_BOTH, True)}, {budget}",
    }
