"""What several query modules share: deduplicated tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.catalog import latest_rows
from lodestack.session import table

WORDS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]+')"
TOKENS = r"len(regexp_extract_all(coalesce({0}, ''), '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]'))"
#: The stated query set among rows with UUIDs: those whose first eight digits are a number divisible by 50.
FIFTIETH = "try_cast('0x' || substr({0}, 1, 8) AS BIGINT) % 50 = 0"
CHUNK = "chunk AS (SELECT * FROM rag_chunk QUALIFY row_number() OVER (PARTITION BY id) = 1)"
DOC = "doc AS (SELECT * FROM rag_document QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1)"
ITEM = "item AS (SELECT * FROM result_item QUALIFY row_number() OVER (PARTITION BY id) = 1)"


def fiftieth(uuid: Column) -> Column:
    """Whether an id belongs to the stated query set; see FIFTIETH."""
    return F.conv(F.substring(uuid, 1, 8), 16, 10).cast("bigint") % 50 == 0


def chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The chunk table, rows that were delivered twice once; only ``columns`` are read."""
    return table(spark, sf_dir, "rag_chunk").select(*columns).dropDuplicates(["id"])


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The latest state of each document."""
    return latest_rows(table(spark, sf_dir, "rag_document").select(*dict.fromkeys([*columns, "id", "updated_at"])))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat parser items, rows that were delivered twice once, in the shape that chunking takes."""
    rows = table(spark, sf_dir, "result_item").dropDuplicates(["id"])
    first = F.get("prov", F.lit(0))
    return rows.select("id", "doc_id", rows.item_no.alias("pos"), "type", "markdown", first["page_no"].alias("page"), first["bbox"].alias("bbox"))
