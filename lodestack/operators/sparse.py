"""Full-text search over postings: boolean matching, then BM25 ranking of what matched.

The index is a DataFrame (term, key, tf, len), made in one pass over the texts;
it can be written bucketed by term. For a batch of queries only the postings of
their terms are made: the terms meet the tokens before anything is shuffled.
The rank function of the engine that this replaces isn't public, so matching is
the parity claim and BM25 is this engine's own ranking.

Defined results: null and blank texts have no postings; a query without terms
matches nothing; repeated rows of a text must be removed before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.text import Analyzer, words
from lodestack.session import checkpointed


def postings(df: DataFrame, key: str, text: str, analyzer: Analyzer = words, terms: DataFrame | None = None) -> DataFrame:
    """One row (term, key, tf, len) per term and text, where ``len`` is the text's number of terms.

    With ``terms`` (term) only theirs: the others are left out before the
    shuffle. Counts are combined before the shuffle too.
    """
    listed = df.select(F.col(key), analyzer(F.col(text)).alias("__terms"))
    tokens = listed.select(F.col(key), F.size("__terms").alias("len"), F.explode("__terms").alias("term"))
    if terms is not None:
        tokens = tokens.join(terms.select("term").distinct(), "term", "left_semi")
    return tokens.groupBy("term", key, "len").agg(F.count("*").alias("tf")).select("term", key, "tf", "len")


def totals(df: DataFrame, text: str, analyzer: Analyzer = words) -> DataFrame:
    """One row (n, avg_len): the texts that have terms, and their mean number of terms."""
    sizes = df.select(F.size(analyzer(F.col(text))).alias("len")).filter(F.col("len") > 0)
    return sizes.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))


def query_terms(df: DataFrame, qid: str, text: str, analyzer: Analyzer = words) -> DataFrame:
    """Plain queries as boolean ones: one AND group (qid, grp, term) per distinct term."""
    terms = F.array_distinct(analyzer(F.col(text)))
    return df.select(F.col(qid).alias("qid"), F.posexplode(terms).alias("grp", "term")).select("qid", F.col("grp").cast("bigint").alias("grp"), "term")


def boolean_match(terms: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Pairs (qid, key) where every group of the query has one of its terms in the text.

    The rarest group of each query gives the candidates; the terms of its other
    groups are then looked up by (term, key), so the long posting list of a
    frequent term is never multiplied with the queries that hold it.
    """
    asked = terms.select("qid", "grp", "term").distinct()
    spread = index.groupBy("term").agg(F.count("*").alias("df"))
    order = Window.partitionBy("qid").orderBy("df", "grp")
    sized = asked.join(spread, "term", "left").fillna({"df": 0}).groupBy("qid", "grp").agg(F.sum("df").alias("df"), F.collect_list("term").alias("terms"))
    ranked = sized.withColumn("nth", F.row_number().over(order)).withColumn("groups", F.count("*").over(Window.partitionBy("qid"))).withColumn("least", F.min("df").over(Window.partitionBy("qid")))
    live = checkpointed(ranked.filter(F.col("least") > 0).select("qid", "grp", "nth", "groups", F.explode("terms").alias("term")))  # a group that is nowhere ends its query
    found = live.filter(F.col("nth") == 1).select("qid", "groups", "term").join(index.select("term", key), "term").select("qid", "groups", key).distinct()
    probes = found.filter(F.col("groups") > 1).join(live.filter(F.col("nth") > 1).select("qid", "grp", "term"), "qid")
    met = probes.join(index.select("term", key), ["term", key], "left_semi").select("qid", "groups", key, "grp").distinct()
    whole = met.groupBy("qid", "groups", key).agg(F.count("*").alias("met")).filter(F.col("met") == F.col("groups") - 1)
    return found.filter(F.col("groups") == 1).select("qid", key).unionByName(whole.select("qid", key))


def bm25(terms: DataFrame, index: DataFrame, counts: DataFrame, key: str, k: int | None = None, k1: float = 1.2, b: float = 0.75, matched: DataFrame | None = None) -> DataFrame:
    """One row (qid, key, score, rank) per text that shares a term with the query, best first.

    ``index`` has the postings of the terms at least, ``counts`` the totals of
    the whole collection. ``matched`` (qid, key) restricts the ranking to the
    texts of a boolean match. Ties go to the smaller key; scores are rounded to
    6 digits before ranking.
    """
    spread = index.groupBy("term").agg(F.count("*").alias("df"))
    asked = terms.select("qid", "term").distinct().join(spread, "term")
    if matched is None:
        hits = asked.join(index, "term")
    else:  # from what matched to its postings, by (term, key)
        hits = matched.join(asked, "qid").join(index, ["term", key])
    hits = hits.crossJoin(F.broadcast(counts))  # one row of totals
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = hits.groupBy("qid", key).agg(F.round(F.sum(weight), 6).alias("score"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), key)
    ranked = scored.withColumn("rank", F.row_number().over(best).cast("bigint"))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def index_for(terms: DataFrame, texts: DataFrame, key: str, text: str, analyzer: Analyzer = words) -> DataFrame:
    """The materialised postings of the queries' terms: one pass over the texts, however often they are used."""
    return checkpointed(postings(texts, key, text, analyzer, terms))


def search(terms: DataFrame, texts: DataFrame, key: str, text: str, k: int, analyzer: Analyzer = words, scope: DataFrame | None = None) -> DataFrame:
    """Full-text top ``k``: texts that meet the whole boolean query ``terms`` (qid, grp, term), ranked (qid, key, score, rank).

    ``scope`` (qid, group_id) restricts a query to the texts of one group, whose
    id ``texts`` has as ``group_id``; queries with a null group search all.
    """
    terms = checkpointed(terms.select("qid", "grp", "term"))  # small, and used five times
    index = index_for(terms, texts, key, text, analyzer)
    matched = boolean_match(terms, index, key)
    if scope is not None:
        groups = texts.select(key, F.col("group_id").alias("__of"))
        within = matched.join(scope.select("qid", "group_id"), "qid").join(groups, key)
        matched = within.filter(F.col("group_id").isNull() | (F.trim("group_id") == F.col("__of"))).select("qid", key)
    return bm25(terms, index, totals(texts, text, analyzer), key, k, matched=matched)
