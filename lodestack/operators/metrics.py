"""Retrieval quality and latency metrics.

``results`` has (qid, id, rank), ``relevant`` (qid, id). Queries without
results score 0; queries without relevant entries have recall and nDCG 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_query(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """One row (qid, recall, mrr, ndcg) per query of either table."""
    wanted = relevant.select("qid", "id").distinct()
    sizes = wanted.groupBy("qid").agg(F.count("*").alias("n"))
    judged = results.join(wanted.withColumn("hit", F.lit(True)), ["qid", "id"], "left").fillna({"hit": False})
    return per_judged(judged, sizes, k)


def per_judged(results: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """The same from judged results (qid, rank, hit) and the number of relevant entries (qid, n) of each query.

    Nothing is joined but one row per query, so it fits relevance that follows
    from a property (a label, a group) shared by very many entries.
    """
    hits = results.filter("hit").groupBy("qid").agg(
        F.count_if(F.col("rank") <= k).alias("found"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1))).alias("dcg")
    )
    asked = results.select("qid").unionByName(sizes.select("qid")).distinct()
    joined = asked.join(sizes, "qid", "left").join(hits, "qid", "left").fillna({"n": 0, "found": 0, "dcg": 0.0})
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return joined.select(
        "qid",
        F.round(F.when(F.col("n") > 0, F.col("found") / F.col("n")).otherwise(0.0), 6).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0), 6).alias("ndcg"),
    )


def mean_of(value: Column) -> Column:
    """Mean of what can be read as a number; NaN and bad values are left out."""
    number = value.try_cast("double")
    return F.avg(F.when(~F.isnan(number), number))


def attach_by_position(rows: DataFrame, scores: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """``rows`` with the columns of ``scores`` at the same place of the same keys, and ``attached``: 'both', or where one side has no such place.

    A column ``id`` of the scores is left out, as a judge numbers its own rows.
    """
    at = [*keys, pos]
    left, right = rows.withColumn("__l", F.lit(True)), scores.drop("id").withColumn("__r", F.lit(True))
    side = F.when(F.col("__l") & F.col("__r"), "both").when(F.col("__l"), "row only").otherwise("score only")
    return left.join(right, at, "full_outer").withColumn("attached", side).drop("__l", "__r")


def gate(means: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """One row (metric, value, threshold, passed) per threshold of a one-row table; a missing value counts 0."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m), F.lit(0.0)).alias("value"), F.lit(float(t)).alias("threshold")) for m, t in thresholds.items()]))
    return means.select(rows.alias("x")).select("x.*").withColumn("passed", F.col("value") >= F.col("threshold"))


def latency(df: DataFrame, group: str, value: str, slices: int = 256) -> DataFrame:
    """Per group n, mean, median and the 95th percentile (the value at place floor(0.95 n), at least the first).

    Exact, without a task that sees a whole group: values are counted in
    ``slices`` equal ranges between the group's ends, the running counts tell
    which range holds each wanted place, and only the values of those ranges
    are ranked, equal ones counted before. Null groups and values that are null
    or not a number are left out.
    """
    given = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter(F.col("g").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    ends = given.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"), F.avg("v").alias("mean"))
    place = F.floor(F.try_divide(F.col("v") - F.col("low"), (F.col("high") - F.col("low")) / slices))
    cut = given.join(ends.select("g", "low", "high"), "g").select("g", "v", F.least(F.coalesce(place, F.lit(0)), F.lit(slices - 1)).alias("slice"))
    sizes = cut.groupBy("g", "slice").agg(F.count("*").alias("held"))
    earlier = Window.partitionBy("g").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # at most ``slices`` rows a group
    sizes = sizes.withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0)))
    n = F.col("n")
    wanted = {"lower": F.floor((n + 1) / 2), "upper": F.floor(n / 2) + 1, "p95": F.greatest(F.floor(n * 0.95), F.lit(1))}
    asked = ends.select("g", F.explode(F.array(*[F.struct(F.lit(k).alias("what"), v.alias("at")) for k, v in wanted.items()])).alias("w")).select("g", "w.what", "w.at")
    spots = sizes.join(asked, "g").filter((F.col("at") > F.col("before")) & (F.col("at") <= F.col("before") + F.col("held"))).select("g", "slice", "what", (F.col("at") - F.col("before")).alias("at"))
    near = cut.join(spots.select("g", "slice").distinct(), ["g", "slice"], "left_semi").groupBy("g", "slice", "v").agg(F.count("*").alias("c"))
    ranked = near.withColumn("upto", F.sum("c").over(Window.partitionBy("g", "slice").orderBy("v")))
    picked = spots.join(ranked, ["g", "slice"]).filter(F.col("upto") >= F.col("at")).groupBy("g").agg(*[F.min(F.when(F.col("what") == k, F.col("v"))).alias(k) for k in wanted])
    return ends.join(picked, "g").select(F.col("g").alias(group), "n", F.round("mean", 6).alias("mean"), F.round((F.col("lower") + F.col("upper")) / 2, 6).alias("median"), "p95")


def histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts (le, n) of values up to each bound, as a latency histogram reports them."""
    row = df.agg(*[F.count_if(F.col(value) <= b).alias(str(i)) for i, b in enumerate(bounds)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(str(i)).alias("n")) for i, b in enumerate(bounds)])).alias("x")).select("x.*")
