"""Queries of retrieval quality, latency and validation, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestack.operators import dense, metrics
from lodestack.session import table
from lodestack.sources import reports

from .retrieval import _asked, _knn_sql


def _quality(spark, sf_dir, k=10):
    """Quality of the exact search where the relevant vectors are those with the query's label.

    The relevant ones are counted by label; only the found ones are looked at one by one.
    """
    vectors = table(spark, sf_dir, "embeddings")
    labels = vectors.select("vec_id", "label")
    results = dense.knn(_asked(spark, sf_dir), vectors, 20, key="vec_id", exclude_self=True).select("qid", "vec_id", "rank")
    asked = labels.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), F.col("label").alias("wanted"))
    judged = results.join(asked, "qid").join(labels, "vec_id").select("qid", "rank", F.coalesce(F.col("label") == F.col("wanted"), F.lit(False)).alias("hit"))
    sizes = asked.join(labels.groupBy(F.col("label").alias("wanted")).agg((F.count("*") - 1).alias("n")), "wanted").select("qid", "n")
    return metrics.per_judged(judged, sizes, k)


def recall_at_k(spark, sf_dir):
    return _quality(spark, sf_dir).select("qid", "recall")


def mrr(spark, sf_dir):
    return _quality(spark, sf_dir).select("qid", "mrr")


def ndcg_at_k(spark, sf_dir):
    return _quality(spark, sf_dir).select("qid", "ndcg")


def metric_means(spark, sf_dir):
    """Mean and count of readable values per kind of event, values inside JSON included."""
    events = table(spark, sf_dir, "events")
    inner = F.get_json_object("props", "$.k")
    return events.groupBy("event_type").agg(F.round(metrics.mean_of(F.col("value")), 6).alias("mean_value"), F.round(metrics.mean_of(inner), 6).alias("mean_k"), F.count("*").alias("n"))


def threshold_gate(spark, sf_dir):
    means = _quality(spark, sf_dir).agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"))
    return metrics.gate(means, {"recall": 0.1, "mrr": 0.5, "ndcg": 0.7})


def latency_percentiles(spark, sf_dir):
    return metrics.latency(table(spark, sf_dir, "events"), "event_type", "value")


def latency_histogram(spark, sf_dir):
    return metrics.histogram(table(spark, sf_dir, "events"), "value", [1.0, 5.0, 10.0, 25.0, 50.0, 100.0])


def reference_check(spark, sf_dir):
    """Evaluation items per set, and how many can't be scored because they are skipped or lack a reference."""
    return reports.reference_check(table(spark, sf_dir, "eval_item"))


def attached_scores(spark, sf_dir):
    """Each set's items with the score at their place; the scores stand for a judge's answer, which knows wanted items only."""
    items = table(spark, sf_dir, "eval_item")
    place = (F.row_number().over(Window.partitionBy("set_name").orderBy("item_id")) - 1).cast("bigint")
    rows = items.select("set_name", place.alias("pos"), "item_id")
    scores = items.filter(~F.coalesce("skip", F.lit(False))).select("set_name", place.alias("pos"), F.lit("x").alias("id"), F.length("ground_truth").cast("bigint").alias("score"))
    return metrics.attach_by_position(rows, scores, ["set_name"])


def report_values(spark, sf_dir):
    """Event values as a report holds them: NaN and infinite ones are null."""
    return reports.json_safe(table(spark, sf_dir, "events").select("event_id", F.col("value")))


def queries():
    found = [recall_at_k, mrr, ndcg_at_k, metric_means, threshold_gate, latency_percentiles, latency_histogram, reference_check, attached_scores, report_values]
    return {f.__name__: f for f in found}


def oracle_sql():
    quality = f"""r AS (SELECT qid, vec_id AS id, rank FROM ({_knn_sql(20, where='q.vec_id <> e.vec_id')})),
        rel AS (SELECT q.vec_id AS qid, e.vec_id AS id FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
        n AS (SELECT qid, count(*) AS n FROM rel GROUP BY 1), a AS (SELECT DISTINCT qid FROM r UNION SELECT DISTINCT qid FROM rel),
        h AS (SELECT qid, count(*) FILTER (WHERE rank <= 10) AS found, min(rank) AS f, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END) AS dcg FROM r JOIN rel USING (qid, id) GROUP BY 1),
        q AS (SELECT qid, round(CASE WHEN n > 0 THEN coalesce(found, 0) / n::DOUBLE ELSE 0.0 END, 6) AS recall, round(coalesce(1.0::DOUBLE / f, 0.0), 6) AS mrr,
          round(CASE WHEN n > 0 THEN coalesce(dcg, 0.0) / list_sum(list_transform(generate_series(1, least(n, 10)), lambda i: 1 / log2(i + 1))) ELSE 0.0 END, 6) AS ndcg FROM a LEFT JOIN n USING (qid) LEFT JOIN h USING (qid))"""
    return {
        "recall_at_k": f"WITH {quality} SELECT qid, recall FROM q",
        "mrr": f"WITH {quality} SELECT qid, mrr FROM q",
        "ndcg_at_k": f"WITH {quality} SELECT qid, ndcg FROM q",
        "metric_means": """SELECT event_type, round(avg(value) FILTER (WHERE NOT isnan(value)), 6) AS mean_value, round(avg(try_cast(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean_k, count(*) AS n FROM events GROUP BY 1""",
        "threshold_gate": f"""WITH {quality}, m AS (SELECT round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM q),
            l AS (SELECT 'recall' AS metric, coalesce(recall, 0.0) AS value, 0.1::DOUBLE AS threshold FROM m UNION ALL SELECT 'mrr', coalesce(mrr, 0.0), 0.5 FROM m UNION ALL SELECT 'ndcg', coalesce(ndcg, 0.0), 0.7 FROM m)
            SELECT metric, value, threshold, value >= threshold AS passed FROM l""",
        "latency_percentiles": """WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
            SELECT event_type, max(n) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) FILTER (WHERE r = greatest(floor(n * 0.95::DOUBLE), 1)) AS p95 FROM s GROUP BY 1""",
        "latency_histogram": "SELECT b::DOUBLE AS le, count(*) FILTER (WHERE value <= b) AS n FROM events, (SELECT unnest([1.0, 5.0, 10.0, 25.0, 50.0, 100.0]) AS b) GROUP BY b",
        "reference_check": """SELECT set_name, count(*) AS items, count(*) FILTER (WHERE skip) AS skipped, count(*) FILTER (WHERE NOT coalesce(skip, false) AND trim(coalesce(ground_truth, '')) = '') AS missing FROM eval_item GROUP BY 1""",
        "attached_scores": """WITH r AS (SELECT set_name, row_number() OVER (PARTITION BY set_name ORDER BY item_id) - 1 AS pos, item_id FROM eval_item),
            s AS (SELECT set_name, row_number() OVER (PARTITION BY set_name ORDER BY item_id) - 1 AS pos, length(ground_truth) AS score, 1 AS r FROM eval_item WHERE NOT coalesce(skip, false))
            SELECT set_name, pos, item_id, score, CASE WHEN item_id IS NULL THEN 'score only' WHEN s.r IS NULL THEN 'row only' ELSE 'both' END AS attached FROM r FULL JOIN s USING (set_name, pos)""",
        "report_values": "SELECT event_id, CASE WHEN isfinite(value) THEN value END AS value FROM events",
    }
