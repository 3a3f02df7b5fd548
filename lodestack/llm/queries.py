"""The queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.plans.common import FIFTIETH, fiftieth
from lodestack.session import table

from . import bpe, canonical, leakage, neardup, scans, similar, splitting


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks of which one is among the other's 5 most similar, at a cosine of at least 0.8."""
    pairs = similar.similar_pairs(similar.nearest(table(spark, sf_dir, "rag_chunk")))
    return pairs.withColumnsRenamed({"id_a": "chunk_id_a", "id_b": "chunk_id_b"})


def p1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar chunks, among all, of the stated query set: ids whose first eight digits are a number divisible by 50."""
    chunks = table(spark, sf_dir, "rag_chunk").select("id", "embedding")
    found = similar.search(chunks, chunks.filter(fiftieth(F.col("id"))))
    return found.select("id", "other", F.round("sim", 6).alias("sim"), F.col("rank").cast("bigint").alias("rank"))


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanned documents as continuous, repaired paragraphs."""
    return scans.repaired(table(spark, sf_dir, "result_item"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case of scanning noise in the items."""
    return scans.found(table(spark, sf_dir, "result_item"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and file names that are the same up to small edits."""
    contents = neardup.similar_contents(table(spark, sf_dir, "rag_chunk"))
    names = neardup.similar_names(table(spark, sf_dir, "rag_document"))
    return contents.select(F.lit("content").alias("field"), "id_a", "id_b").unionByName(names.select(F.lit("filename").alias("field"), "id_a", "id_b"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of near-duplicate chunks and file names: field, id, class and number of links."""
    contents = neardup.content_groups(table(spark, sf_dir, "rag_chunk"))
    names = neardup.name_groups(table(spark, sf_dir, "rag_document"))
    return contents.select(F.lit("content").alias("field"), "*").unionByName(names.select(F.lit("filename").alias("field"), "*"))


def _oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "result_item").select(F.lit("item").alias("record"), F.col("id").alias("record_id"), F.col("markdown").alias("text"))
    chunks = table(spark, sf_dir, "rag_chunk").select(F.lit("chunk").alias("record"), F.col("id").alias("record_id"), F.col("content").alias("text"))
    return items.unionByName(chunks)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every oversized item and chunk, and whether a cut has to be forced."""
    return splitting.split_records(_oversized(spark, sf_dir)).select("record", "record_id", "cut").distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized item and chunk."""
    return splitting.split_records(_oversized(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    return bpe.encode_texts(table(spark, sf_dir, "documents"))


def _held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.passages(table(spark, sf_dir, "eval_item"), "item_id", ["question", "ground_truth"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 12 consecutive words of an evaluation item."""
    windows = leakage.leaked_windows(table(spark, sf_dir, "documents"), _held_out(spark, sf_dir))
    return windows.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of an evaluation item each document holds, with one substituted word allowed per window."""
    windows = leakage.leaked_windows(table(spark, sf_dir, "documents"), _held_out(spark, sf_dir), substitutions=1)
    return leakage.leak_report(windows).withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents whose texts differ as stored but look the same."""
    docs = table(spark, sf_dir, "documents")
    pairs = canonical.same_form_pairs(canonical.text_forms(docs))
    return pairs.select(F.col("key_a").alias("doc_id_a"), F.col("key_b").alias("doc_id_b"))


def p8_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that looks like a differently stored one, with the smallest id of its form."""
    rows = canonical.form_classes(canonical.text_forms(table(spark, sf_dir, "documents")))
    return rows.select(F.col("key").alias("doc_id"), F.col("class_key").alias("class_id"), F.col("n").alias("n_rows"))


def p8_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text in the consistent form."""
    return table(spark, sf_dir, "documents").select("doc_id", canonical.canonical_text("text", canonical.look_alikes(spark)).alias("form"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p1_topk, p2_found, p2_paragraphs, p3_found, p3_groups, p4_found, p4_pieces, p6_ids, p7_found, p7_leaks, p8_found, p8_groups, p8_forms]
    return {f.__name__: f for f in found}


# problem 1 as it is stated, by brute force
_RANKED = """vector AS MATERIALIZED (SELECT id, any_value(embedding)::DOUBLE[96] AS v FROM rag_chunk WHERE id IS NOT NULL AND len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY id),
            alike AS (SELECT a.id, b.id AS other, array_cosine_similarity(a.v, b.v) AS sim FROM vector a JOIN vector b ON a.id <> b.id {0}),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS rank FROM alike QUALIFY rank <= 5)"""
# problem 3 as it is stated, by an inverted join of words and by all names of like length; every letter of two names becomes one byte, as the edit distance counts bytes
_SIMILAR = r"""text AS (SELECT DISTINCT id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM rag_chunk WHERE id IS NOT NULL AND content IS NOT NULL),
            sized AS (SELECT id, w, len(w) AS total FROM text WHERE len(w) BETWEEN 20 AND 400),
            bag AS (SELECT id, total, word, count(*) AS n FROM (SELECT id, total, unnest(w) AS word FROM sized) GROUP BY ALL),
            content_pair AS (SELECT a.id AS id_a, b.id AS id_b FROM bag a JOIN bag b ON a.word = b.word AND a.id < b.id AND 5 * b.total >= 4 * a.total AND 5 * a.total >= 4 * b.total
              GROUP BY a.id, b.id, a.total, b.total HAVING 5 * sum(least(a.n, b.n)) >= 4 * (a.total + b.total - sum(least(a.n, b.n)))),
            named AS (SELECT DISTINCT id, regexp_replace(lower(regexp_replace(filename, '\.[^.]*$', '')), '[^\p{L}\p{N}]', '', 'g') AS name FROM rag_document WHERE id IS NOT NULL AND filename IS NOT NULL),
            long_name AS (SELECT id, name, length(name) AS n FROM named WHERE length(name) >= 12),
            couple AS (SELECT a.id AS id_a, b.id AS id_b, a.name AS a, b.name AS b, greatest(a.n, b.n) AS n, array_to_string(list_distinct(string_split(a.name || b.name, '')), '') AS letters
              FROM long_name a JOIN long_name b ON a.id < b.id AND abs(a.n - b.n) * 100 <= 15 * greatest(a.n, b.n)),
            coded AS (SELECT *, substr((SELECT string_agg(chr(i::INT), '' ORDER BY i) FROM range(32, 127) t(i)), 1, length(letters)) AS ascii FROM couple),
            name_pair AS (SELECT DISTINCT id_a, id_b FROM coded WHERE levenshtein(translate(a, letters, ascii), translate(b, letters, ascii)) * 100 <= 15 * n),
            pair AS (SELECT 'content' AS field, id_a, id_b FROM content_pair UNION ALL SELECT 'filename', id_a, id_b FROM name_pair)"""


def oracle_sql() -> dict[str, str]:
    """The SQL that is quick enough on whole tables: problems 1, 3 and 4, whose definitions SQL can state."""
    token = r"regexp_extract_all(regexp_replace({0}, '[\p{{L}}\p{{N}}]+', 'x', 'g'), '[^\s\p{{Z}}]')"
    return {
        "p1_found": f"WITH {_RANKED.format('')} SELECT DISTINCT least(id, other) AS chunk_id_a, greatest(id, other) AS chunk_id_b FROM ranked WHERE sim >= 0.8",
        "p1_topk": f"WITH {_RANKED.format('AND ' + FIFTIETH.format('a.id'))} SELECT id, other, round(sim, 6) AS sim, rank FROM ranked",
        "p3_found": f"WITH {_SIMILAR} SELECT field, id_a, id_b FROM pair",
        "p3_groups": f"""WITH RECURSIVE {_SIMILAR}, link AS (SELECT field, id_a AS id, id_b AS other FROM pair UNION ALL SELECT field, id_b, id_a FROM pair),
            reach AS (SELECT field, id, other FROM link UNION SELECT reach.field, reach.id, link.other FROM reach JOIN link ON link.field = reach.field AND link.id = reach.other),
            record AS (SELECT 'content' AS field, id FROM sized UNION SELECT 'filename', id FROM long_name)
            SELECT field, id, coalesce((SELECT min(other) FROM reach WHERE reach.field = r.field AND reach.id = r.id), id) AS class_id,
              (SELECT count(*) FROM link WHERE link.field = r.field AND link.id = r.id) AS links FROM record r""",
        "p4_found": rf"""WITH r AS (SELECT DISTINCT 'item' AS record, id AS record_id, markdown AS t FROM result_item UNION SELECT DISTINCT 'chunk', id, content FROM rag_chunk),
            big AS (SELECT * FROM r WHERE length(t) > 768 AND len({token.format('t')}) > 768),
            s AS (SELECT record, record_id, unnest(regexp_split_to_array(regexp_replace(t, '([.!?。！？])\s+', '\1' || chr(10), 'g'), '\n|\r')) AS s FROM big)
            SELECT record, record_id, CASE WHEN max(len({token.format('s')})) > 768 THEN 'forced' ELSE 'natural' END AS cut FROM s GROUP BY record, record_id""",
    }
