"""Layout items to searchable chunks.

Headings go before the next body, tables become one whole parent and a chunk
per row, oversized texts are packed sentence by sentence. All of it is built-in
expressions and windows over a document's reading order; only HTML tables pass
through Python. A chunk's id is a hash of its document and position, so that
rows find their parent's id without a join.

Defined results: null and blank texts and page furniture give nothing; headings
alone give nothing; repeated rows of an item must be removed before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import tables
from lodestack.schema import HEADING_TYPES, SKIP_TYPES, TABLE_TYPES

_SPACE = " \t\n\r"


def kept_items(items: DataFrame) -> DataFrame:
    """Items with visible text that aren't page furniture; ``markdown`` is trimmed."""
    trimmed = items.withColumn("markdown", F.trim(F.coalesce("markdown", F.lit("")), F.lit(_SPACE)))
    return trimmed.filter((F.col("markdown") != "") & ~F.coalesce(F.col("type").isin(*SKIP_TYPES), F.lit(False)))


def carry_headings(items: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Kept items without the headings, each with the ``heading`` directly before it (the last of several)."""
    order = Window.partitionBy(doc).orderBy(pos)
    is_heading = F.coalesce(F.col("type").isin(*HEADING_TYPES), F.lit(False))
    before = F.when(F.lag(is_heading, 1, False).over(order), F.lag("markdown").over(order))
    return items.withColumn("heading", before).filter(~is_heading)


def pack(text: Column, limit: int, count: T.Counter = T.token_count) -> Column:
    """A text as parts of whole sentences with at most ``limit`` tokens each.

    A part's size is the sum of its sentences' counts. A sentence that is too
    large alone is packed word by word into parts of its own. A text without
    sentences is one part.
    """
    size = lambda s: count(s).cast("int")
    one = lambda s, i: F.struct(s.alias("text"), size(s).alias("n"), F.lit(-1).alias("solo"))
    split = lambda s, i: F.transform(F.filter(F.split(s, r"\s+", -1), lambda w: w != ""), lambda w: F.struct(w.alias("text"), size(w).alias("n"), i.cast("int").alias("solo")))
    units = F.flatten(F.transform(T.sentences(text), lambda s, i: F.when(size(s) > limit, split(s, i)).otherwise(F.array(one(s, i)))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(-1).alias("solo"))

    def step(acc: Column, unit: Column) -> Column:
        full = (acc["text"] != "") & ((acc["n"] + unit["n"] > limit) | (acc["solo"] != unit["solo"]))
        done = F.when(full, F.array_append(acc["done"], acc["text"])).otherwise(acc["done"])
        fresh = full | (acc["text"] == "")
        joined = F.when(fresh, unit["text"]).otherwise(F.concat(acc["text"], F.lit(" "), unit["text"]))
        return F.struct(done.alias("done"), joined.alias("text"), F.when(fresh, unit["n"]).otherwise(acc["n"] + unit["n"]).alias("n"), unit["solo"].alias("solo"))

    finish = lambda acc: F.when(acc["text"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["text"]))
    parts = F.aggregate(units, start, step, finish)
    return F.when(F.size(parts) == 0, F.array(text)).otherwise(parts)


def chunk_id(doc: Column, index: Column) -> Column:
    """The id of a document's chunk: the same on every run."""
    return F.md5(F.concat_ws("#", doc, index.cast("string")))


def chunk_items(items: DataFrame, limit: int = 768, count: T.Counter = T.token_count) -> DataFrame:
    """Chunks of ``items`` (doc_id, pos, type, markdown, page, bbox).

    One row (id, doc_id, chunk_index, content, token_count, page, type, bbox,
    searchable, parent_chunk_index, parent_chunk_id) per chunk.
    """
    body = carry_headings(kept_items(items))
    table = tables.is_table(F.col("type"), F.col("markdown"))
    plain = body.filter(~table).withColumn("is_table", F.lit(False)).withColumn("rows", F.array().cast("array<string>"))
    kind = F.when(F.col("type").isin(*TABLE_TYPES), F.col("type")).otherwise("table")
    tabled = body.filter(table).withColumn("type", kind).withColumn("is_table", F.lit(True)).withColumn("markdown", tables.to_pipes(F.col("markdown")))
    tabled = tabled.withColumn("rows", tables.pipe_rows(F.col("markdown")))
    tabled = tabled.withColumn("rows", F.when((F.size("rows") == 0) & F.col("markdown").rlike(r"(?i)<tr\b"), tables.rows_of_html(F.col("markdown"))).otherwise(F.col("rows")))

    whole = F.when(F.col("heading").isNotNull(), F.concat("heading", F.lit("\n\n"), "markdown")).otherwise(F.col("markdown"))
    parent = F.struct(whole.alias("content"), F.col("type").alias("type"), (F.size("rows") == 0).alias("searchable"), F.lit(False).alias("is_row"))
    row = lambda r: F.struct(r.alias("content"), F.lit("table_row").alias("type"), F.lit(True).alias("searchable"), F.lit(True).alias("is_row"))
    units = plain.unionByName(tabled).select("doc_id", "pos", "page", "bbox", F.posexplode(F.concat(F.array(parent), F.transform("rows", row))).alias("unit", "u"))
    flat = units.select("doc_id", "pos", "page", "bbox", "unit", "u.*")
    parts = F.when(F.col("searchable") & (count(F.col("content")) > limit), pack(F.col("content"), limit, count)).otherwise(F.array("content"))
    cut = flat.select("*", F.posexplode(parts).alias("part", "text")).drop("content").withColumn("text", F.trim("text", F.lit(_SPACE))).filter(F.col("text") != "")

    order = Window.partitionBy("doc_id").orderBy("pos", "unit", "part")
    indexed = cut.withColumn("chunk_index", (F.row_number().over(order) - 1).cast("int"))
    own = Window.partitionBy("doc_id", "pos").orderBy("unit", "part")
    indexed = indexed.withColumn("parent_chunk_index", F.when(F.col("is_row"), F.first("chunk_index").over(own)))
    return indexed.select(
        chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("id"), "doc_id", "chunk_index", F.col("text").alias("content"), count(F.col("text")).cast("int").alias("token_count"), "page", "type", "bbox",
        "searchable", "parent_chunk_index", F.when(F.col("is_row"), chunk_id(F.col("doc_id"), F.col("parent_chunk_index"))).alias("parent_chunk_id"),
    )


def document_markdown(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The rendered text of each document (doc_id, rendered), else its non-blank items joined by blank lines; documents without either have no row."""
    visible = items.filter(F.trim(F.coalesce("markdown", F.lit("")), F.lit(_SPACE)) != "")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "markdown")))
    joined = visible.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["markdown"]), "\n\n").alias("joined"))
    given = documents.select("doc_id", F.nullif(F.trim("rendered"), F.lit("")).alias("given"))
    return given.join(joined, "doc_id", "left").select("doc_id", F.coalesce("given", "joined").alias("markdown")).filter(F.col("markdown").isNotNull())


def ingest_status(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document its state after chunking (doc_id, status, chunk_count, error_message): all chunks count, none is a failure."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    joined = documents.select("doc_id").join(counts, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.select(
        "doc_id", F.when(F.col("n") > 0, "completed").otherwise("failed").alias("status"), F.col("n").alias("chunk_count"), F.when(F.col("n") == 0, "no chunks").alias("error_message")
    )


def index_rows(chunks: DataFrame, analyzer: T.Analyzer = T.words) -> DataFrame:
    """Chunks with ``content_morph``, the searchable terms; chunks that aren't searchable have none."""
    terms = F.array_join(analyzer(F.col("content")), " ")
    return chunks.withColumn("content_morph", F.when(F.col("searchable"), F.when(terms == "", F.col("content")).otherwise(terms)))
