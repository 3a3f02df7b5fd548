"""Glossary: surfaces, longest-match segmentation, query expansion, definitions and upsert.

Everything is derived from the glossary table when a query is planned, so no
process keeps a stale copy. Surfaces are found in queries by equi-joins and
built-in expressions; neither table is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.arrays import clean_list
from lodestack.functions.text import Analyzer, words


def surfaces(terms: DataFrame) -> DataFrame:
    """One row (surface, aliases, standard) per standard term or synonym of the enabled terms.

    A surface that several terms share has all their aliases (not those of the
    terms that these share in turn); its standard is that of the smallest id.
    """
    standard = F.trim("standard_term")
    known = terms.filter(F.col("enabled") & (F.coalesce(standard, F.lit("")) != "")).select("id", standard.alias("standard"), clean_list(F.concat(F.array("standard_term"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("aliases"))
    each = known.select("id", "standard", F.explode("aliases").alias("surface"), "aliases")
    return each.groupBy("surface").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"), F.min_by("standard", "id").alias("standard"))


def definitions(terms: DataFrame) -> DataFrame:
    """(standard, definition) of the enabled terms that have one; of repeated standards the largest id counts."""
    given = terms.filter(F.col("enabled")).select("id", F.trim("standard_term").alias("standard"), F.trim("definition").alias("definition"))
    return given.filter((F.col("standard") != "") & (F.col("definition") != "")).groupBy("standard").agg(F.max_by("definition", "id").alias("definition"))


def _folded(text):
    """Lower case, letter by letter; a letter whose lower case has another length stays, so that places fit the text."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.length(F.lower(c)) == 1, F.lower(c)).otherwise(c)), "")


def surface_hits(queries: DataFrame, known: DataFrame) -> DataFrame:
    """One row (qid, start, stop, surface) per place of a query (qid, query) at which a surface stands, ignoring case.

    Each stretch of the query that is as long as some surface is looked up by
    an equi-join, so the glossary may be of any size; of surfaces that differ
    in case only the smallest counts. ``start`` counts from 1, ``stop`` is the
    place behind the surface.
    """
    names = known.select("surface", _folded(F.col("surface")).alias("folded")).groupBy("folded").agg(F.min("surface").alias("surface"))
    lengths = names.agg(F.collect_set(F.length("folded")).alias("lengths"))  # one row; as many entries as there are lengths
    text = queries.filter(F.length("query") > 0).select("qid", _folded(F.col("query")).alias("text")).crossJoin(F.broadcast(lengths))
    spots = text.select("qid", "text", "lengths", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("start"))
    spots = spots.select("qid", "text", "start", F.explode("lengths").alias("n")).filter(F.col("start") + F.col("n") <= F.length("text") + 1)
    stretches = spots.select("qid", "start", (F.col("start") + F.col("n")).alias("stop"), F.substr("text", F.col("start"), F.col("n")).alias("folded"))
    return stretches.join(names, "folded").select("qid", "start", "stop", "surface")


def longest_hits(hits: DataFrame) -> DataFrame:
    """The ``hits`` that stand: longer ones first, then by surface and place, each where no earlier one overlaps it.

    Only hits that hang together by overlapping compete, so each such cluster
    is decided for itself; a hit that overlaps none needs no decision.
    """
    order = Window.partitionBy("qid").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = hits.withColumn("opens", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1)))
    placed = opened.withColumn("cluster", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = F.array_sort(F.collect_list(F.struct((F.col("start") - F.col("stop")).alias("shorter"), "surface", "start", "stop")))
    clear = lambda held, h: ~F.exists(held, lambda k: (k["start"] < h["stop"]) & (h["start"] < k["stop"]))
    shape = "array<struct<shorter: int, surface: string, start: int, stop: int>>"
    chosen = F.aggregate("ranked", F.array().cast(shape), lambda held, h: F.when(clear(held, h), F.array_append(held, h)).otherwise(held))
    return placed.groupBy("qid", "cluster").agg(ranked.alias("ranked")).select("qid", F.explode(chosen).alias("hit")).select("qid", "hit.start", "hit.stop", "hit.surface")


def segments(queries: DataFrame, known: DataFrame, qid: str = "qid", text: str = "query") -> DataFrame:
    """One row (qid, seg, segment, surface) per segment of each query: surfaces claim their text longest first, gaps have none.

    Blank gaps are left out; null and blank queries have no rows; repeated rows
    of a query count once.
    """
    asked = queries.select(F.col(qid).alias("qid"), F.col(text).alias("query")).filter(F.length(F.trim(F.regexp_replace(text, r"\s", " "))) > 0).distinct()
    held = longest_hits(surface_hits(asked, known)).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "surface"))).alias("hits"))
    none = F.lit(None).cast("string")
    part = lambda start, stop, surface: F.struct(F.substr("query", start, stop - start).alias("segment"), surface.alias("surface"))
    joined = asked.join(held, "qid", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<start: int, stop: int, surface: string>>")))
    behind = lambda i: F.when(i > 0, F.get("hits", i - 1)["stop"]).otherwise(F.lit(1))
    body = F.flatten(F.transform("hits", lambda h, i: F.array(part(behind(i), h["start"], none), part(h["start"], h["stop"], h["surface"]))))
    last = F.when(F.size("hits") > 0, F.element_at("hits", -1)["stop"]).otherwise(F.lit(1))
    parts = F.filter(F.concat(body, F.array(part(last, F.length("query") + 1, none))), lambda p: p["surface"].isNotNull() | p["segment"].rlike(r"(?U)\S"))
    return joined.select("qid", F.posexplode(parts).alias("seg", "p")).select("qid", F.col("seg").cast("bigint").alias("seg"), "p.segment", "p.surface")


def _kept(terms, charset: str | None):
    return terms if charset is None else F.filter(terms, lambda t: t.rlike(f"^(?:{charset})$"))


def expanded_terms(parts: DataFrame, known: DataFrame, analyzer: Analyzer = words, charset: str | None = None, queries: DataFrame | None = None) -> DataFrame:
    """Boolean query (qid, grp, term): each term of a gap is a group of its own, a surface one group of all its aliases' terms.

    Terms that don't wholly match ``charset`` are dropped. A query of
    ``queries`` (qid, query) that has no term left, or no segment, falls back
    to all the terms that the analyzer gives, each a group of its own.
    """
    gaps = parts.filter(F.col("surface").isNull()).select("qid", "seg", F.posexplode(F.array_distinct(_kept(analyzer(F.col("segment")), charset))).alias("at", "term"))
    hits = parts.filter(F.col("surface").isNotNull()).join(known.select("surface", "aliases"), "surface")
    either = hits.select("qid", "seg", F.lit(-1).alias("at"), F.explode(F.array_distinct(_kept(F.flatten(F.transform("aliases", analyzer)), charset))).alias("term"))
    made = gaps.unionByName(either).select("qid", F.concat_ws(".", "seg", "at").alias("grp"), "term").distinct()
    if queries is None:
        return made
    blank = queries.select("qid", "query").join(made.select("qid").distinct(), "qid", "left_anti")
    plain = blank.select("qid", F.posexplode(F.array_distinct(analyzer(F.col("query")))).alias("at", "term"))
    return made.unionByName(plain.select("qid", F.concat(F.lit("f."), F.col("at").cast("string")).alias("grp"), "term"))


def matched_definitions(parts: DataFrame, known: DataFrame, defined: DataFrame) -> DataFrame:
    """(qid, standard, definition, seg) of the surfaces that a query mentions, once per standard.

    The matched surface is looked up, not the query's own spelling of it.
    """
    met = parts.filter(F.col("surface").isNotNull()).join(known.select("surface", "standard"), "surface").groupBy("qid", "standard").agg(F.min("seg").alias("seg"))
    return met.join(defined, "standard").select("qid", "standard", "definition", "seg")


def glossary_block(matched: DataFrame) -> DataFrame:
    """Per query the block of its definitions (qid, block), in the order of the query."""
    ordered = F.array_sort(F.collect_list(F.struct("seg", "standard", "definition")))
    lines = F.transform(ordered, lambda x: F.concat(F.lit("- "), x["standard"], F.lit(": "), x["definition"]))
    return matched.groupBy("qid").agg(F.concat(F.lit("[Glossary]\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("block"))


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The glossary after an import (id, standard_term, synonyms, category, definition, enabled, action).

    An incoming term replaces the row with its id, else the one with its
    standard term, whose id stays. Of several for one row the last (largest
    incoming id) wins.
    """
    fields = ["standard_term", "synonyms", "category", "definition", "enabled"]
    new = incoming.select(F.col("id").alias("new_id"), *[F.col(c).alias(f"new_{c}") for c in fields])
    by_id = new.join(stored.select(F.col("id").alias("by_id")), F.col("new_id") == F.col("by_id"), "left")
    by_name = stored.groupBy(F.col("standard_term").alias("name")).agg(F.min("id").alias("by_name"))
    routed = by_id.join(by_name, F.col("new_standard_term") == F.col("name"), "left").withColumn("target", F.coalesce("by_id", "by_name", "new_id"))
    last = Window.partitionBy("target").orderBy(F.desc("new_id"))
    routed = routed.withColumn("nth", F.row_number().over(last)).filter(F.col("nth") == 1)
    both = stored.select("id", *fields).join(routed, F.col("id") == F.col("target"), "full_outer")
    changed = F.col("target").isNotNull()
    action = F.when(~changed, "kept").when(F.col("id").isNull(), "inserted").otherwise("updated")
    return both.select(F.coalesce("id", "target").alias("id"), *[F.when(changed, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in fields], action.alias("action"))


def amended(stored: DataFrame, term_id: str, **changes) -> DataFrame:
    """The glossary with some fields of one term changed; None leaves a field as it is."""
    out = stored
    for column, value in changes.items():
        if value is not None:
            out = out.withColumn(column, F.when(F.col("id") == term_id, F.lit(value).cast(stored.schema[column].dataType)).otherwise(F.col(column)))
    return out


def without(stored: DataFrame, term_id: str) -> DataFrame:
    return stored.filter(F.col("id") != term_id)
