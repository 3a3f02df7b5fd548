"""Evaluation sets in, reports out."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def reference_check(items: DataFrame) -> DataFrame:
    """Per set (set_name, items, skipped, missing): ``missing`` items are wanted but have no reference answer."""
    skipped = F.coalesce("skip", F.lit(False))
    blank = F.trim(F.coalesce("ground_truth", F.lit(""))) == ""
    return items.groupBy("set_name").agg(F.count("*").alias("items"), F.count_if(F.col("skip")).alias("skipped"), F.count_if(~skipped & blank).alias("missing"))


def evaluation_sets(spark: SparkSession, path: str) -> DataFrame:
    """Items (set_name, item_id, question, ground_truth, group_id, top_k, skip) of a YAML file or of a folder's, sorted by name.

    Sets with ``use: false`` are left out; items inherit the set's defaults.
    Needs a YAML reader, which is imported here so that nothing else does.
    """
    import yaml

    root = Path(path)
    files = [root] if root.is_file() else sorted(p for p in root.iterdir() if p.suffix in (".yaml", ".yml"))
    rows = []
    for file in files:
        data = yaml.safe_load(file.read_text(encoding="utf-8-sig")) or {}
        if data.get("use", True) is False:
            continue
        base = data.get("defaults") or {}
        for item in data.get("items") or []:
            top_k = item.get("top_k", base.get("top_k"))
            rows.append((data.get("name") or file.stem, str(item["id"]), item.get("question"), item.get("ground_truth"), item.get("group_id", base.get("group_id")), top_k, bool(item.get("skip", False))))
    shape = "set_name string, item_id string, question string, ground_truth string, group_id string, top_k int, skip boolean"
    return spark.createDataFrame(rows, shape)


def json_safe(df: DataFrame) -> DataFrame:
    """Numbers that JSON can't hold (NaN, infinite) as null."""
    for field in df.schema:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(field.name)
            df = df.withColumn(field.name, F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c))
    return df


def write_report(df: DataFrame, path: str) -> None:
    """A report as UTF-8 JSON lines, nulls kept."""
    json_safe(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
