"""Schemas of the tables and of the rows that pass between operators."""

from __future__ import annotations

BBOX = "struct<l: double, t: double, r: double, b: double, coord_origin: string>"
PROV = f"array<struct<page_no: int, bbox: {BBOX}, charspan: array<string>>>"
ITEM = f"struct<id: string, type: string, markdown: string, prov: {PROV}>"
GROUPS = "id string, slug string, created_at timestamp, updated_at timestamp"
DOCUMENTS = (
    "id string, group_id string, filename string, content_type string, parse_json string, tag array<string>, metadata string,"
    " status string, error_message string, chunk_count int, created_at timestamp, updated_at timestamp, deleted_at timestamp"
)
CHUNKS = (
    "id string, doc_id string, group_id string, chunk_index int, content string, token_count int, page int, type string,"
    f" bbox {BBOX}, parent_chunk_id string, content_morph string, embedding array<float>, created_at timestamp"
)
GLOSSARY = "id string, standard_term string, synonyms array<string>, category string, definition string, enabled boolean, created_at timestamp, updated_at timestamp"

# Item types by their part in chunking, and document states.
SKIP_TYPES = ("number", "header", "footer")
HEADING_TYPES = ("doc_title", "paragraph_title")
TABLE_TYPES = ("table", "table_text")
STATUSES = ("pending", "processing", "completed", "failed", "deleted")
GROUP_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"
