"""Queries of the glossary, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.operators import glossary, sparse
from lodestack.session import checkpointed, table

from .common import CHUNK, WORDS, chunks


def _terms(spark, sf_dir):
    return table(spark, sf_dir, "glossary_term")


def _segments(spark, sf_dir):
    """Segments of every evaluation question and every definition."""
    asked = table(spark, sf_dir, "eval_item").select(F.col("item_id").alias("qid"), F.col("question").alias("query"))
    asked = asked.unionByName(_terms(spark, sf_dir).select(F.col("id").alias("qid"), F.concat_ws(" ", "standard_term", "definition").alias("query")))
    known = glossary.surfaces(_terms(spark, sf_dir))
    return checkpointed(glossary.segments(asked, known)), known


def glossary_surfaces(spark, sf_dir):
    return glossary.surfaces(_terms(spark, sf_dir)).select("surface", F.array_join("aliases", "|").alias("aliases"), "standard")


def glossary_segments(spark, sf_dir):
    return _segments(spark, sf_dir)[0]


def glossary_expand_terms(spark, sf_dir):
    parts, known = _segments(spark, sf_dir)
    return glossary.expanded_terms(parts, known)


def glossary_matches(spark, sf_dir):
    """Chunks that match the expanded queries: gaps by every word, surfaces by any alias."""
    parts, known = _segments(spark, sf_dir)
    terms = checkpointed(glossary.expanded_terms(parts, known))
    index = sparse.index_for(terms, chunks(spark, sf_dir, "id", "content").withColumnRenamed("id", "chunk_id"), "chunk_id", "content")
    return sparse.boolean_match(terms, index, "chunk_id")


def glossary_definitions(spark, sf_dir):
    return glossary.definitions(_terms(spark, sf_dir))


def glossary_block(spark, sf_dir):
    parts, known = _segments(spark, sf_dir)
    return glossary.glossary_block(glossary.matched_definitions(parts, known, glossary.definitions(_terms(spark, sf_dir))))


def _incoming(spark, sf_dir):
    """An import made of the table itself: terms without a category under new ids, categories cleaned."""
    terms = _terms(spark, sf_dir)
    return terms.withColumn("id", F.when(F.col("category").isNull(), F.concat(F.lit("N"), "id")).otherwise(F.col("id"))).withColumn("category", F.lower(F.trim("category"))).withColumn("enabled", F.lit(True))


def glossary_upsert(spark, sf_dir):
    stored = _terms(spark, sf_dir).filter("enabled")
    after = glossary.upsert(stored, _incoming(spark, sf_dir))
    return after.select("id", "standard_term", "category", "enabled", "action")


def queries():
    found = [glossary_surfaces, glossary_segments, glossary_expand_terms, glossary_matches, glossary_definitions, glossary_block, glossary_upsert]
    return {f.__name__: f for f in found}


_CLEAN = "list_distinct(list_filter(list_transform(list_prepend(standard_term, coalesce(synonyms, [])), lambda v: trim(v)), lambda v: v IS NOT NULL AND v <> ''))"
_KNOWN = f"""known AS (SELECT surface, list_sort(list_distinct(flatten(list(aliases)))) AS aliases, arg_min(standard, id) AS standard FROM
      (SELECT id, trim(standard_term) AS standard, {_CLEAN} AS aliases, unnest({_CLEAN}) AS surface FROM glossary_term WHERE enabled AND coalesce(trim(standard_term), '') <> '') GROUP BY surface)"""
_DEFINED = """defined AS (SELECT trim(standard_term) AS standard, arg_max(trim(definition), id) AS definition FROM glossary_term WHERE enabled AND trim(standard_term) <> '' AND trim(definition) <> '' GROUP BY 1)"""


def segments_sql(asked: str) -> str:
    """The CTEs from ``asked`` (qid, query) to ``seg`` (qid, seg, segment, surface)."""
    return f"""{_KNOWN}, names AS (SELECT lower(surface) AS folded, min(surface) AS surface FROM known GROUP BY 1), widths AS (SELECT DISTINCT length(folded) AS n FROM names),
        spots AS (SELECT qid, query, unnest(generate_series(1, length(query))) AS start FROM {asked} WHERE regexp_matches(query, '\\S')),
        hit AS (SELECT qid, start, start + n AS stop, names.surface FROM spots, widths JOIN names ON names.folded = lower(substr(query, start, n)) AND length(names.folded) = n WHERE start + n <= length(query) + 1),
        ordered AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY stop - start DESC, surface, start) AS i FROM hit),
        walk AS (SELECT DISTINCT qid, 0::BIGINT AS i, []::STRUCT(start BIGINT, stop BIGINT, surface VARCHAR)[] AS held FROM ordered UNION ALL
          SELECT o.qid, o.i, CASE WHEN len(list_filter(held, lambda k: k.start < o.stop AND o.start < k.stop)) > 0 THEN held
            ELSE list_append(held, struct_pack(start := o.start::BIGINT, stop := o.stop::BIGINT, surface := o.surface)) END FROM walk JOIN ordered o ON o.qid = walk.qid AND o.i = walk.i + 1),
        stand AS (SELECT qid, h.start AS start, h.stop AS stop, h.surface AS surface FROM (SELECT qid, unnest(arg_max(held, i)) AS h FROM walk GROUP BY qid)),
        edge AS (SELECT a.qid, a.query, s.start, s.stop, s.surface, lag(s.stop, 1, 1) OVER (PARTITION BY a.qid ORDER BY s.start) AS behind FROM {asked} a JOIN stand s USING (qid)),
        piece AS (SELECT qid, behind AS spot, substr(query, behind, start - behind) AS segment, NULL AS surface FROM edge WHERE start > behind AND regexp_matches(substr(query, behind, start - behind), '\\S')
          UNION ALL SELECT qid, start, substr(query, start, stop - start), surface FROM edge
          UNION ALL SELECT qid, coalesce(stop, 1), substr(query, coalesce(stop, 1)), NULL FROM {asked} LEFT JOIN (SELECT qid, max(stop) AS stop FROM stand GROUP BY 1) USING (qid) WHERE regexp_matches(substr(query, coalesce(stop, 1)), '\\S')),
        seg AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY spot) - 1 AS seg, segment, surface FROM piece)"""


def expand_sql(asked: str) -> str:
    """The CTEs from ``asked`` to ``terms`` (qid, grp, term)."""
    return f"""{segments_sql(asked)},
        gap AS (SELECT qid, seg, list_distinct({WORDS.format('segment')}) AS d, {WORDS.format('segment')} AS w FROM seg WHERE surface IS NULL),
        terms AS (SELECT DISTINCT qid, seg || '.' || (list_position(list_filter(w, lambda x, i: list_position(w, x) = i), x) - 1) AS grp, x AS term FROM (SELECT qid, seg, w, unnest(d) AS x FROM gap)
          UNION SELECT DISTINCT qid, seg || '.-1', term FROM (SELECT qid, seg, unnest({WORDS.format('alias')}) AS term FROM (SELECT qid, seg, unnest(aliases) AS alias FROM seg JOIN known USING (surface))))"""


def block_sql() -> str:
    """The CTEs from ``seg`` and ``known`` to ``block`` (qid, block)."""
    return f"""{_DEFINED}, met_terms AS (SELECT qid, standard, min(seg) AS seg FROM seg JOIN known USING (surface) GROUP BY 1, 2),
        block AS (SELECT qid, '[Glossary]' || chr(10) || string_agg('- ' || standard || ': ' || definition, chr(10) ORDER BY seg, standard) || chr(10) AS block FROM met_terms JOIN defined USING (standard) GROUP BY qid)"""


def oracle_sql():
    asked = "asked AS (SELECT item_id AS qid, question AS query FROM eval_item UNION ALL SELECT id, concat_ws(' ', standard_term, definition) FROM glossary_term)"
    return {
        "glossary_surfaces": f"WITH {_KNOWN} SELECT surface, array_to_string(aliases, '|') AS aliases, standard FROM known",
        "glossary_segments": f"WITH RECURSIVE {asked}, {segments_sql('asked')} SELECT qid, seg, segment, surface FROM seg",
        "glossary_expand_terms": f"WITH RECURSIVE {asked}, {expand_sql('asked')} SELECT qid, grp, term FROM terms",
        "glossary_matches": f"""WITH RECURSIVE {CHUNK}, {asked}, {expand_sql('asked')}, need AS (SELECT qid, count(DISTINCT grp) AS needed FROM terms GROUP BY 1),
            idx AS (SELECT DISTINCT id AS chunk_id, unnest({WORDS.format('content')}) AS term FROM chunk)
            SELECT qid, chunk_id FROM terms JOIN idx USING (term) JOIN need USING (qid) GROUP BY qid, chunk_id, needed HAVING count(DISTINCT grp) = needed""",
        "glossary_block": f"WITH RECURSIVE {asked}, {segments_sql('asked')}, {block_sql()} SELECT qid, block FROM block",
        "glossary_definitions": """SELECT trim(standard_term) AS standard, arg_max(trim(definition), id) AS definition FROM glossary_term
            WHERE enabled AND trim(standard_term) <> '' AND trim(definition) <> '' GROUP BY 1""",
        "glossary_upsert": """WITH s AS (SELECT * FROM glossary_term WHERE enabled),
            n AS (SELECT CASE WHEN category IS NULL THEN 'N' || id ELSE id END AS nid, standard_term, lower(trim(category)) AS category, true AS enabled FROM glossary_term),
            r AS (SELECT n.*, coalesce(s.id, (SELECT min(m.id) FROM s m WHERE m.standard_term = n.standard_term), nid) AS target FROM n LEFT JOIN s ON s.id = nid),
            l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY target ORDER BY nid DESC) = 1)
            SELECT coalesce(s.id, l.target) AS id, CASE WHEN l.target IS NOT NULL THEN l.standard_term ELSE s.standard_term END AS standard_term,
              CASE WHEN l.target IS NOT NULL THEN l.category ELSE s.category END AS category, CASE WHEN l.target IS NOT NULL THEN l.enabled ELSE s.enabled END AS enabled,
              CASE WHEN l.target IS NULL THEN 'kept' WHEN s.id IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM s FULL JOIN l ON s.id = l.target""",
    }
