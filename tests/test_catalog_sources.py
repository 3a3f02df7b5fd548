import json

from pyspark.sql import functions as F

from lodestack.functions.arrays import clean_list, contains_all
from lodestack.operators import catalog, filters
from lodestack.sources import files, models, parse, reports
from lodestack.streaming import ingest


def test_tags(spark):
    df = spark.createDataFrame([(1, [" a", "", "b", "a", None]), (2, None), (3, ["b"])], "id int, tag array<string>")
    assert [r[0] for r in df.orderBy("id").select(clean_list(F.col("tag"))).collect()] == [["a", "b"], [], ["b"]]
    assert [r["id"] for r in df.filter(contains_all(F.col("tag"), ["b", " "])).orderBy("id").collect()] == [1, 3]
    assert df.filter(contains_all(F.col("tag"), [])).count() == 3
    assert filters.by_tags(df, "b").count() == 2


def test_group_ids(spark):
    df = spark.createDataFrame([("ok-1",), (" pad ",), ("has space",), ("",), (None,), ("a" * 129,)], "g string")
    assert [r[0] for r in df.select(filters.group_id_problem(F.col("g"))).collect()] == [None, None, "malformed", "missing", "missing", "malformed"]
    made = [r[0] for r in df.select(filters.resolved_group_id(F.col("g"))).collect()]
    assert made[:2] == ["ok-1", "pad"] and all(made)


def test_soft_delete_is_idempotent_and_replace_keeps_others(spark):
    docs = spark.createDataFrame([("a", "completed", None), ("b", "completed", None)], "id string, status string, deleted_at timestamp")
    chunks = spark.createDataFrame([("c1", "a", [1.0], "m"), ("c2", "b", [1.0], "m")], "id string, doc_id string, embedding array<float>, content_morph string")
    doomed = docs.filter("id = 'a'").select("id")
    docs2, chunks2 = catalog.soft_delete(docs, chunks, doomed)
    assert {r["id"]: r["status"] for r in docs2.collect()} == {"a": "deleted", "b": "completed"}
    assert {r["id"]: r["embedding"] is None for r in chunks2.collect()} == {"c1": True, "c2": False}
    again, _ = catalog.soft_delete(docs2, chunks2, doomed)
    assert again.filter("status = 'deleted'").count() == 1
    fresh = spark.createDataFrame([("c9", "a")], "id string, doc_id string")
    assert {r["id"] for r in catalog.replace_chunks(chunks, fresh).collect()} == {"c2", "c9"}


def test_names_links_and_backfill(spark):
    df = spark.createDataFrame([("11111111-x", "n", 1), ("22222222-y", "n", 2), ("33333333-z", None, 3)], "id string, name string, at int")
    assert {r["id"][0]: r["name"] for r in catalog.unique_names(df, "name", ["at"]).collect()} == {"1": "n", "2": "n-22222222", "3": None}
    groups = spark.createDataFrame([("g1", "acme")], "id string, slug string")
    docs = spark.createDataFrame([("d", "acme", None), ("e", "else", None)], "id string, tenant string, group_id string")
    assert {r["id"]: r["group_id"] for r in catalog.backfill_groups(docs, groups, "tenant", "dflt").collect()} == {"d": "g1", "e": "dflt"}
    new = catalog.new_documents(spark.createDataFrame([(None, "f", "t", ["", " "])], "group_id string, filename string, content_type string, tag array<string>")).first()
    assert new["status"] == "pending" and new["tag"] is None and new["group_id"]


def test_parse_sources(spark):
    texts = [("a", '{"results": [{"type": "text", "markdown": "x", "prov": [{"page_no": 2, "bbox": {"l": 1.5}}]}]}'), ("b", '[{"markdown": "y", "prov": {"page_no": "3"}}]'), ("c", "{}"), ("d", "nope"), ("e", None)]
    df = spark.createDataFrame(texts, "id string, j string")
    rows = {r["doc_id"]: (r["markdown"], r["page"]) for r in parse.read_items(df, "id", "j").collect()}
    assert rows == {"a": ("x", 2), "b": ("y", 3)}
    assert {r["doc_id"]: r["problem"] for r in parse.unreadable(df, "id", "j").collect()} == {"c": "no results", "d": "not JSON", "e": "missing"}


def test_glossary_csv_and_uploads(spark, tmp_path):
    (tmp_path / "g.csv").write_text("﻿term_id,standard_term,synonyms,category,definition,more\n1,Tax ,a| b |Tax|a,,\"x, y\",z\n,skipped,,,,\n2,,,,,\n", encoding="utf-8")
    rows = files.glossary_csv(spark, str(tmp_path / "g.csv")).collect()
    assert [(r["id"], r["standard_term"], r["synonyms"], r["category"], r["definition"]) for r in rows] == [("1", "Tax", ["a", "b"], None, "x, y")]
    (tmp_path / ".hidden").write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.txt").write_text("x")
    assert {r["name"] for r in files.uploads(spark, str(tmp_path)).collect()} == {"g.csv", "b.txt"}


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 0.5)], "id int, v double")
    reports.write_report(df, str(tmp_path / "r"))
    read = [json.loads(line) for f in (tmp_path / "r").glob("part-*") for line in f.read_text().splitlines()]
    assert sorted((r["id"], r["v"]) for r in read) == [(1, None), (2, None), (3, 0.5)] or {r["id"]: r["v"] for r in read} == {1: None, 2: None, 3: 0.5}


def test_embedding_seam(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma"), (2, None), (3, "")], "id int, t string")
    rows = {r["id"]: r["embedding"] for r in models.embed_texts(df, "t").collect()}
    assert rows[2] is None and abs(sum(v * v for v in rows[1]) - 1) < 1e-6
    assert tuple(models.indexed(models.embed_texts(df, "t")).first()) == (2, 1)


def test_streaming_ingest_reads_only_new_files(spark, small, tmp_path):
    src, sink, check = (str(tmp_path / n) for n in ("src", "sink", "check"))
    docs = spark.read.parquet(f"{small}/rag_document.parquet")
    docs.limit(5).write.parquet(src)
    ingest.start(spark, src, sink, check).awaitTermination()
    first = ingest.current_chunks(spark, sink)
    n = first.count()
    assert n > 0 and first.select("id").distinct().count() == n
    docs.limit(5).write.mode("append").parquet(src)
    ingest.start(spark, src, sink, check).awaitTermination()
    assert ingest.current_chunks(spark, sink).count() == n
