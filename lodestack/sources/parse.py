"""Parser results as layout items.

Accepts what parsers deliver: a response object, a bare list of items, JSON
inside a JSON string, with or without a byte-order mark. Items come out flat,
in the shape that chunking takes; unreadable texts give no items, and
:func:`unreadable` names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.nested import bound, read_variant
from lodestack.schema import BBOX


def _items(value: Column) -> Column:
    whole = lambda v: F.schema_of_variant(v).startswith("ARRAY")
    return bound(value, lambda v: F.when(whole(v), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.try_variant_get(v, "$.results", "array<variant>")))


def read_items(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row (doc_id, pos, type, markdown, page, bbox) per item of the JSON texts."""
    each = df.select(F.col(key).cast("string").alias("doc_id"), F.posexplode(_items(read_variant(F.col(text)))).alias("pos", "item"))
    prov = F.coalesce(F.try_variant_get("item", "$.prov[0]", "variant"), F.try_variant_get("item", "$.prov", "variant"))
    each = each.withColumn("first", prov)
    page = F.try_variant_get("first", "$.page_no", "double").cast("int")
    return each.select("doc_id", "pos", F.try_variant_get("item", "$.type", "string").alias("type"), F.try_variant_get("item", "$.markdown", "string").alias("markdown"), page.alias("page"), F.try_variant_get("first", "$.bbox", BBOX).alias("bbox"))


def unreadable(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (doc_id, problem) of texts that can't be read: 'missing', 'not JSON' or 'no results'."""
    value = read_variant(F.col(text))
    state = bound(value, lambda v: F.when(v.isNull(), "not JSON").when(_items(v).isNull() & F.try_variant_get(v, "$.status", "string").isNull(), "no results"))
    problem = F.when(F.col(text).isNull(), "missing").otherwise(state)
    return df.select(F.col(key).cast("string").alias("doc_id"), problem.alias("problem")).filter(F.col("problem").isNotNull())
