"""Queries of reading, chunking and indexing documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import chunking, nested, tables
from lodestack.session import table
from lodestack.sources import parse

from .common import CHUNK, ITEM, TOKENS, WORDS, chunks, items

# -------------------------------------------------------------- nested JSON


def _parse_tables(spark, sf_dir) -> dict[str, DataFrame]:
    documents = table(spark, sf_dir, "rag_document")
    return nested.shred(nested.latest(documents, "id", "updated_at", "parse_json"), "id", "parse_json", lists=("results", "prov"), maps=("pages",))


def _whole(column: str):
    return F.expr(f"try_cast(`{column}` AS double)").cast("int")


def p5_found(spark, sf_dir):
    """Items, provenance entries and pages of the latest parse of every document."""
    found = _parse_tables(spark, sf_dir)
    none = F.lit(-1)
    rows = [found["document"].limit(0).select(F.col("record").alias("doc_id"), F.lit("").alias("node"), none.alias("item_no"), none.alias("sub_no"), none.alias("page_no"))]
    if "results" in found:
        top = found["results"].filter(F.col("parent") == "document")
        rows.append(top.select(F.col("record").alias("doc_id"), F.lit("item").alias("node"), F.col("pos").alias("item_no"), none.alias("sub_no"), none.alias("page_no")))
    if "prov" in found:
        entries = found["prov"].filter(F.col("parent") == "results")
        item_no = F.element_at(F.split("parent_id", "/"), -1).cast("int")
        page = F.coalesce(_whole("page_no"), none) if "page_no" in entries.columns else none
        rows.append(entries.select(F.col("record").alias("doc_id"), F.lit("prov").alias("node"), item_no.alias("item_no"), F.col("pos").alias("sub_no"), page.alias("page_no")))
    if "pages" in found:
        pages = found["pages"]
        own = _whole("page_no") if "page_no" in pages.columns else F.lit(None)
        page = F.coalesce(own, _whole("key_"), none)
        rows.append(pages.select(F.col("record").alias("doc_id"), F.lit("page").alias("node"), none.alias("item_no"), none.alias("sub_no"), page.alias("page_no")))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def p5_items(spark, sf_dir):
    """The table of parser items, linked to their documents."""
    return _parse_tables(spark, sf_dir)["results"]


def p5_provenance(spark, sf_dir):
    """The table of provenance entries, linked to the items or cells they hang from."""
    return _parse_tables(spark, sf_dir)["prov"]


# ------------------------------------------------------------------ chunking


def skip_types(spark, sf_dir):
    return chunking.kept_items(items(spark, sf_dir)).select("id", "doc_id", "pos", "type", "markdown")


def heading_carry(spark, sf_dir):
    return chunking.carry_headings(chunking.kept_items(items(spark, sf_dir))).select("id", "type", "heading")


def page_bbox(spark, sf_dir):
    """The place of each item: its first provenance entry's."""
    return items(spark, sf_dir).select("id", "page", F.col("bbox.l").alias("l"), F.col("bbox.t").alias("t"), F.col("bbox.coord_origin").alias("origin"))


def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


def pack_sentences(spark, sf_dir):
    """Documents packed to 64 tokens, oversized sentences word by word."""
    rows = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    return rows.select("doc_id", F.posexplode(chunking.pack(F.col("text"), 64)).alias("part", "content"))


def table_predicate(spark, sf_dir):
    return items(spark, sf_dir).filter(F.col("markdown").isNotNull()).select("id", tables.is_table(F.col("type"), F.col("markdown")).alias("is_table"))


def table_row_split(spark, sf_dir):
    return chunks(spark, sf_dir, "id", "content").select("id", F.posexplode(tables.pipe_rows(F.col("content"))).alias("row_no", "row"))


def parent_child_emit(spark, sf_dir):
    """Chunks of the scanned documents without a size limit: whole parents, rows and texts in their order."""
    made = chunking.chunk_items(items(spark, sf_dir), limit=1_000_000_000)
    return made.select("doc_id", "chunk_index", "type", "content", "searchable", "parent_chunk_index")


def chunk_items(spark, sf_dir):
    """Chunks of the scanned documents at the default limit, ready for the index."""
    return chunking.index_rows(chunking.chunk_items(items(spark, sf_dir))).drop("bbox")


def chunk_counts(spark, sf_dir):
    """State and number of chunks of each document after ingest."""
    read = parse.read_items(nested.latest(table(spark, sf_dir, "rag_document"), "id", "updated_at", "parse_json"), "id", "parse_json")
    ids = table(spark, sf_dir, "rag_document").select(F.col("id").alias("doc_id")).distinct()
    return chunking.ingest_status(ids, chunking.chunk_items(read))


def ingest_parse(spark, sf_dir):
    """From parser JSON, HTML tables included, to chunks."""
    read = parse.read_items(nested.latest(table(spark, sf_dir, "rag_document"), "id", "updated_at", "parse_json"), "id", "parse_json")
    return chunking.chunk_items(read).drop("bbox")


def html_table_md(spark, sf_dir):
    """Every HTML table among the parser's items as a pipe table."""
    read = parse.read_items(nested.latest(table(spark, sf_dir, "rag_document"), "id", "updated_at", "parse_json"), "id", "parse_json")
    return read.filter(F.col("markdown").rlike(tables.HAS_HTML)).select("doc_id", "pos", tables.to_pipes(F.col("markdown")).alias("markdown"), F.size(tables.rows_of_html(F.col("markdown"))).alias("html_rows"))


def parse_problems(spark, sf_dir):
    """Documents whose parser result can't be read, and why."""
    return parse.unreadable(nested.latest(table(spark, sf_dir, "rag_document"), "id", "updated_at", "parse_json"), "id", "parse_json")


def document_markdown(spark, sf_dir):
    rows = items(spark, sf_dir)
    return chunking.document_markdown(rows.select("doc_id", F.lit(None).cast("string").alias("rendered")).distinct(), rows)


def index_terms(spark, sf_dir):
    """The searchable terms of every chunk, as the index stores them."""
    rows = chunks(spark, sf_dir, "id", "content").withColumn("searchable", F.lit(True))
    return chunking.index_rows(rows).select("id", "content_morph")


_KEPT_ONLY = r"kept AS (SELECT id, doc_id, item_no AS pos, type, trim(coalesce(markdown, ''), chr(32) || chr(9) || chr(10) || chr(13)) AS markdown FROM item WHERE trim(coalesce(markdown, ''), chr(32) || chr(9) || chr(10) || chr(13)) <> '' AND coalesce(type, '') NOT IN ('number', 'header', 'footer'))"
_KEPT = f"{ITEM}, {_KEPT_ONLY}"
_CARRIED_ONLY = """carried AS (SELECT *, CASE WHEN lag(coalesce(type, '') IN ('doc_title', 'paragraph_title')) OVER w THEN lag(markdown) OVER w END AS heading FROM kept
    WINDOW w AS (PARTITION BY doc_id ORDER BY pos) QUALIFY coalesce(type, '') NOT IN ('doc_title', 'paragraph_title'))"""
_CARRIED = f"{_KEPT}, {_CARRIED_ONLY}"
_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, chr(32) || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"
_LINES = r"list_filter(list_transform(string_split({0}, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13))), lambda x: starts_with(x, '|'))"
_ROWS = r"CASE WHEN len({0}) >= 3 AND len(list_filter({0}[2:], lambda x: NOT regexp_matches(x, '^\|[\s\-:|]+\|$'))) >= 2 THEN list_transform(list_filter({0}[2:], lambda x: NOT regexp_matches(x, '^\|[\s\-:|]+\|$')), lambda x: {0}[1] || chr(10) || x) ELSE [] END"
_IS_TABLE = r"(coalesce(type, '') IN ('table', 'table_text') OR regexp_matches(trim(markdown, chr(32) || chr(9) || chr(10) || chr(13)), '^(?s)\|.*\|') OR regexp_matches(markdown, '(?i)<table\b'))"


# HTML tables as the parser writes them: one row and one cell after the other, without spans, attributes or tables within
_CELLS = "list_transform(regexp_extract_all(markdown, '<tr>(.*?)</tr>', 1), lambda r: list_transform(regexp_extract_all(r, '<td>(.*?)</td>', 1), lambda c: trim(c)))"
_PIPES = """array_to_string(list_transform(cells, lambda c, i: '| ' || array_to_string(c, ' | ') || ' |' || CASE WHEN i = 1 THEN chr(10) || '| ' || array_to_string(list_transform(c, lambda x: '---'), ' | ') || ' |' ELSE '' END), chr(10))"""
_EMITTED_ONLY = f"""{_KEPT_ONLY}, {_CARRIED_ONLY}, h AS (SELECT *, {_IS_TABLE} AS tab, {_CELLS} AS cells FROM carried), g AS (SELECT * EXCLUDE (markdown, cells), CASE WHEN tab AND len(cells) > 0 THEN {_PIPES} ELSE markdown END AS markdown FROM h),
            l AS (SELECT *, {_LINES.format('markdown')} AS ls FROM g), r AS (SELECT *, CASE WHEN tab THEN {_ROWS.format('ls')} ELSE [] END AS rs FROM l),
            p AS (SELECT doc_id, pos, 0 AS unit, CASE WHEN tab AND coalesce(type, '') NOT IN ('table', 'table_text') THEN 'table' ELSE type END AS type, CASE WHEN heading IS NOT NULL THEN heading || chr(10) || chr(10) || markdown ELSE markdown END AS content, len(rs) = 0 AS searchable FROM r),
            c AS (SELECT doc_id, pos, unnest(generate_series(1, len(rs))) AS unit, 'table_row' AS type, unnest(rs) AS content, true AS searchable FROM r WHERE len(rs) > 0),
            e AS (SELECT * FROM p UNION ALL SELECT * FROM c)"""
_EMITTED = f"{ITEM}, {_EMITTED_ONLY}"


def _packed(limit: int) -> str:
    """The CTEs from ``src`` (doc_id, text) to ``packed`` (doc_id, part, content); they need WITH RECURSIVE."""
    return f"""s AS (SELECT doc_id, text, {_SENTENCES} AS x FROM src),
            sent AS (SELECT doc_id, unnest(generate_series(1, len(x))) AS pos, unnest(x) AS t FROM s WHERE len(x) > 0),
            sized AS (SELECT *, {TOKENS.format('t')} AS n FROM sent),
            units AS (SELECT doc_id, pos, 0 AS w, t, n, -1 AS solo FROM sized WHERE n <= {limit} UNION ALL
              SELECT doc_id, pos, w, t, {TOKENS.format('t')} AS n, pos AS solo FROM (SELECT doc_id, pos, unnest(generate_series(1, len(ws))) AS w, unnest(ws) AS t
                FROM (SELECT doc_id, pos, list_filter(regexp_split_to_array(t, '\\s+'), lambda q: q <> '') AS ws FROM sized WHERE n > {limit}))),
            u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, w) AS i FROM units),
            walk AS (SELECT doc_id, i, t, 0 AS part, n, solo FROM u WHERE i = 1 UNION ALL
              SELECT u.doc_id, u.i, u.t, CASE WHEN walk.n + u.n > {limit} OR walk.solo <> u.solo THEN walk.part + 1 ELSE walk.part END,
                CASE WHEN walk.n + u.n > {limit} OR walk.solo <> u.solo THEN u.n ELSE walk.n + u.n END, u.solo FROM walk JOIN u ON u.doc_id = walk.doc_id AND u.i = walk.i + 1),
            packed AS (SELECT doc_id, part::INT AS part, string_agg(t, ' ' ORDER BY i) AS content FROM walk GROUP BY 1, 2 UNION ALL SELECT doc_id, 0::INT, text FROM s WHERE len(x) = 0)"""


def _chunked(limit: int) -> str:
    """The CTEs from ``e`` and ``placed`` (doc_id, pos, page) to ``chunked``; they need WITH RECURSIVE."""
    return f"""k AS (SELECT *, concat_ws('#', doc_id, pos, unit) AS spot FROM e), src AS (SELECT spot AS doc_id, content AS text FROM k WHERE searchable AND {TOKENS.format('content')} > {limit}), {_packed(limit)},
            cut AS (SELECT k.doc_id, pos, unit, type, searchable, coalesce(part, 0) AS part, trim(coalesce(packed.content, k.content), chr(32) || chr(9) || chr(10) || chr(13)) AS content FROM k LEFT JOIN packed ON packed.doc_id = k.spot),
            n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY pos, unit, part) - 1)::INT AS chunk_index FROM cut WHERE content <> ''),
            f AS (SELECT *, CASE WHEN unit > 0 THEN first_value(chunk_index) OVER (PARTITION BY doc_id, pos ORDER BY unit, part) END AS parent_chunk_index FROM n),
            chunked AS (SELECT md5(f.doc_id || '#' || chunk_index) AS id, f.doc_id, chunk_index, content, {TOKENS.format('content')}::INT AS token_count, page, type, searchable, parent_chunk_index,
              CASE WHEN unit > 0 THEN md5(f.doc_id || '#' || parent_chunk_index) END AS parent_chunk_id FROM f JOIN placed ON placed.doc_id = f.doc_id AND placed.pos = f.pos)"""


def _entries(value: str, name: str, always_map: bool = False) -> str:
    """The entries of a JSON value's list, map or single object as a list of (key, value)."""
    at = f"{value}->'$.{name}'"
    number = "true" if always_map else f"len(json_keys({at})) > 0 AND len(list_filter(json_keys({at}), lambda k: NOT regexp_matches(k, '^\\d+$'))) = 0"
    return f"""CASE json_type({at}) WHEN 'ARRAY' THEN list_transform(json_extract({value}, '$.{name}[*]'), lambda v: struct_pack(key := NULL::VARCHAR, value := v))
              WHEN 'OBJECT' THEN CASE WHEN {number} THEN list_transform(json_keys({at}), lambda k: struct_pack(key := k, value := json_extract({at}, '$."' || k || '"')))
                ELSE [struct_pack(key := NULL::VARCHAR, value := {at})] END END"""


def _nodes(name: str, source: str, path: str, value: str = "value", always_map: bool = False) -> str:
    """A CTE of the rows of a repeated element below ``source``."""
    return f"""{name} AS (SELECT record, node_id AS parent_id, node_id || '/{path}/' || coalesce(e.key, pos::VARCHAR) AS node_id, pos, e.key AS key_, e.value AS value
            FROM (SELECT record, node_id, unnest(range(len(es)))::INT AS pos, unnest(es) AS e FROM (SELECT record, node_id, {_entries(value, path, always_map)} AS es FROM {source})))"""


_BARE = r"regexp_replace({0}, '^[\x{{FEFF}}\s]+', '')"
_LAYER = "CASE WHEN NOT starts_with(t, '\"') THEN t WHEN json_valid(t) THEN " + _BARE.format("json_extract_string(t, '$')") + " END AS t"
_READ = f"""latest AS (SELECT id AS record, parse_json FROM rag_document WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, parse_json DESC NULLS LAST) = 1),
            t0 AS (SELECT record, parse_json, {_BARE.format('parse_json')} AS t FROM latest), t1 AS (SELECT record, parse_json, {_LAYER} FROM t0),
            t2 AS (SELECT record, parse_json, {_LAYER} FROM t1), t3 AS (SELECT record, parse_json, {_LAYER} FROM t2),
            parsed AS (SELECT record, parse_json, CASE WHEN regexp_matches(t, '^[{{\\[]') THEN try_cast(t AS JSON) END AS j FROM t3)"""
_SHREDDED = f"""{_READ}, document AS (SELECT record, record AS node_id, CASE json_type(j) WHEN 'ARRAY' THEN json_object('results', j) ELSE j END AS value FROM parsed WHERE j IS NOT NULL),
            {_nodes('results', 'document', 'results')}, {_nodes('prov', 'results', 'prov')}, {_nodes('pages', 'document', 'pages', always_map=True)}"""
_PARSED_ITEMS = """item AS (SELECT record AS doc_id, record || '/' || i AS id, i AS item_no, x->>'$.type' AS type, x->>'$.markdown' AS markdown,
            trunc(try_cast(coalesce(x->'$.prov[0]', x->'$.prov')->>'$.page_no' AS DOUBLE))::INT AS page FROM (SELECT record, unnest(range(len(xs)))::INT AS i, unnest(xs) AS x
              FROM (SELECT record, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') WHEN json_type(j, '$.results') = 'ARRAY' THEN json_extract(j, '$.results[*]') END AS xs FROM parsed)))"""
_PARSED_CHUNKS = f"{_READ}, {_PARSED_ITEMS}, {_EMITTED_ONLY}, placed AS (SELECT doc_id, item_no AS pos, page FROM item), {_chunked(768)}"
_PAGE = "trunc(try_cast({0}->>'$.page_no' AS DOUBLE))::INT"


def queries():
    found = [p5_found, p5_items, p5_provenance, skip_types, heading_carry, page_bbox, sentence_split, pack_sentences, table_predicate, table_row_split, parent_child_emit, chunk_items]
    found += [chunk_counts, ingest_parse, html_table_md, parse_problems, document_markdown, index_terms]
    return {f.__name__: f for f in found}


def oracle_sql():
    lines = _LINES.format("content")
    cells = f"cell_items AS (SELECT record, node_id, value->'$.extra' AS value FROM results), {_nodes('cells', 'cell_items', 'cells').replace('/cells/', '/extra.cells/')}, {_nodes('cell_prov', 'cells', 'prov')}"
    box = ", ".join(f"""try_cast(value->>'$.bbox.{c}' AS DOUBLE) AS "bbox.{c}\"""" for c in "blrt")
    return {
        "p5_found": f"""WITH {_SHREDDED} SELECT record AS doc_id, 'item' AS node, pos AS item_no, -1 AS sub_no, -1 AS page_no FROM results
            UNION ALL SELECT p.record, 'prov', r.pos, p.pos, coalesce({_PAGE.format('p.value')}, -1) FROM prov p JOIN results r ON r.node_id = p.parent_id
            UNION ALL SELECT record, 'page', -1, -1, coalesce({_PAGE.format('value')}, trunc(try_cast(key_ AS DOUBLE))::INT, -1) FROM pages""",
        "p5_items": f"""WITH {_SHREDDED} SELECT record, 'document' AS parent, parent_id, node_id, pos, key_, try_cast(value->>'$.extra.confidence' AS DOUBLE) AS "extra.confidence",
            value->>'$.id' AS id, value->>'$.markdown' AS markdown, value->>'$.type' AS type FROM results""",
        "p5_provenance": f"""WITH {_SHREDDED}, {cells}, every AS (SELECT 'results' AS parent, * FROM prov UNION ALL SELECT 'cells', * FROM cell_prov)
            SELECT record, parent, parent_id, node_id, pos, key_, {box}, value->>'$.bbox.coord_origin' AS "bbox.coord_origin", value->>'$.charspan' AS charspan,
            CASE json_type(value, '$.page_no') WHEN 'DOUBLE' THEN regexp_replace(value->>'$.page_no', '\\.0+$', '') ELSE value->>'$.page_no' END AS page_no FROM every""",
        "parse_problems": f"""WITH {_READ} SELECT record AS doc_id, CASE WHEN parse_json IS NULL THEN 'missing' WHEN j IS NULL THEN 'not JSON' ELSE 'no results' END AS problem FROM parsed
            WHERE j IS NULL OR (json_type(j) <> 'ARRAY' AND coalesce(json_type(j, '$.results'), '') <> 'ARRAY' AND j->>'$.status' IS NULL)""",
        "skip_types": f"WITH {_KEPT} SELECT id, doc_id, pos, type, markdown FROM kept",
        "heading_carry": f"WITH {_CARRIED} SELECT id, type, heading FROM carried",
        "page_bbox": f"WITH {ITEM} SELECT id, prov[1].page_no AS page, prov[1].bbox.l AS l, prov[1].bbox.t AS t, prov[1].bbox.coord_origin AS origin FROM item",
        "sentence_split": f"WITH s AS (SELECT doc_id, {_SENTENCES} AS x FROM documents) SELECT doc_id, unnest(generate_series(0, len(x) - 1))::INT AS pos, unnest(x) AS sentence FROM s WHERE len(x) > 0",
        "pack_sentences": f"""WITH RECURSIVE src AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), {_packed(64)}
            SELECT doc_id, part, content FROM packed""",
        "table_predicate": f"WITH {ITEM} SELECT id, {_IS_TABLE} AS is_table FROM item WHERE markdown IS NOT NULL",
        "table_row_split": f"""WITH {CHUNK}, l AS (SELECT id, {lines} AS ls FROM chunk), r AS (SELECT id, {_ROWS.format('ls')} AS rs FROM l)
            SELECT id, unnest(generate_series(0, len(rs) - 1))::INT AS row_no, unnest(rs) AS row FROM r WHERE len(rs) > 0""",
        "parent_child_emit": f"""WITH {_EMITTED}, n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY pos, unit) - 1)::INT AS chunk_index FROM e)
            SELECT doc_id, chunk_index, type, content, searchable, CASE WHEN unit > 0 THEN first_value(chunk_index) OVER (PARTITION BY doc_id, pos ORDER BY unit) END AS parent_chunk_index FROM n""",
        "chunk_items": f"""WITH RECURSIVE {_EMITTED}, placed AS (SELECT doc_id, item_no AS pos, prov[1].page_no AS page FROM item), {_chunked(768)}
            SELECT * EXCLUDE m, CASE WHEN searchable THEN CASE WHEN m = '' THEN content ELSE m END END AS content_morph FROM (SELECT *, array_to_string({WORDS.format('content')}, ' ') AS m FROM chunked)""",
        "ingest_parse": f"WITH RECURSIVE {_PARSED_CHUNKS} SELECT * FROM chunked",
        "chunk_counts": f"""WITH RECURSIVE {_PARSED_CHUNKS}, counted AS (SELECT doc_id, count(*) AS n FROM chunked GROUP BY 1)
            SELECT d.doc_id, CASE WHEN n > 0 THEN 'completed' ELSE 'failed' END AS status, coalesce(n, 0) AS chunk_count, CASE WHEN n IS NULL THEN 'no chunks' END AS error_message
            FROM (SELECT DISTINCT id AS doc_id FROM rag_document) d LEFT JOIN counted USING (doc_id)""",
        "html_table_md": f"""WITH {_READ}, {_PARSED_ITEMS}, h AS (SELECT doc_id, item_no AS pos, {_CELLS} AS cells FROM item WHERE regexp_matches(markdown, '(?i)<t[rdh]'))
            SELECT doc_id, pos, {_PIPES} AS markdown, CASE WHEN len(cells) > 1 THEN len(cells) ELSE 0 END::INT AS html_rows FROM h""",
        "document_markdown": f"""WITH {ITEM} SELECT doc_id, string_agg(markdown, chr(10) || chr(10) ORDER BY item_no) AS markdown FROM item
            WHERE trim(coalesce(markdown, ''), chr(32) || chr(9) || chr(10) || chr(13)) <> '' GROUP BY doc_id""",
        "index_terms": f"""WITH {CHUNK}, t AS (SELECT id, content, array_to_string({WORDS.format('content')}, ' ') AS m FROM chunk) SELECT id, CASE WHEN m = '' THEN content ELSE m END AS content_morph FROM t""",
    }
