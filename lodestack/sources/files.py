"""Files as tables: folders of uploads, and the glossary as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.arrays import clean_list


def uploads(spark: SparkSession, path: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """Files below a folder (path, name, length, modificationTime[, content]); hidden files and folders are left out.

    The content is read only if asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    visible = files.withColumn("name", name).filter(~F.col("path").rlike(r"/\.[^/]"))
    return visible if content else visible.drop("content")


def glossary_csv(spark: SparkSession, path: str) -> DataFrame:
    """A glossary (id, standard_term, synonyms, category, definition, enabled) from CSV with a header, byte-order mark or not.

    Synonyms are split at ``|``, trimmed, without the term itself and
    repetitions; rows without id or term are skipped; other columns are ignored.
    """
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    for name in ("term_id", "standard_term", "synonyms", "category", "definition"):
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast("string"))
    filled = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    rows = raw.select(filled("term_id").alias("id"), filled("standard_term").alias("standard_term"), "synonyms", filled("category").alias("category"), filled("definition").alias("definition"))
    others = F.filter(clean_list(F.split(F.coalesce("synonyms", F.lit("")), r"\|")), lambda s: s != F.col("standard_term"))
    kept = rows.filter(F.col("id").isNotNull() & F.col("standard_term").isNotNull())
    return kept.select("id", "standard_term", others.alias("synonyms"), "category", "definition", F.lit(True).alias("enabled"))
