import json

from lodestack.operators import nested


def shredded(spark, texts):
    df = spark.createDataFrame([(str(i), t, "x") for i, t in enumerate(texts)], "id string, body string, record string")
    return {k: v.collect() for k, v in nested.shred(df, "id", "body", lists=("results", "prov"), maps=("pages",)).items()}


def test_children_are_linked_to_their_parents(spark):
    doc = {"status": "ok", "results": [{"id": "a", "prov": [{"page_no": 1}, {"page_no": "2"}], "extra": {"score": 0.5, "cells": [{"row": 0, "prov": [{"page_no": 9}]}]}}], "pages": {"1": {"size": {"w": 3}}, "2": {"page_no": 7}}}
    t = shredded(spark, [json.dumps(doc)])
    assert set(t) == {"document", "results", "prov", "cells", "pages"}
    item = t["results"][0]
    assert item["extra.score"] == 0.5 and item["parent"] == "document" and item["parent_id"] == "0"
    assert {(r["parent"], r["page_no"]) for r in t["prov"]} == {("results", "1"), ("results", "2"), ("cells", "9")}
    ids = {r["node_id"] for name in ("results", "cells") for r in t[name]}
    assert all(r["parent_id"] in ids for r in t["prov"])
    assert {(r["key_"], r["size.w"], r["page_no"]) for r in t["pages"]} == {("1", 3.0, None), ("2", None, 7.0)}


def test_irregular_texts(spark):
    bare = json.dumps([{"id": "a", "prov": {"page_no": 3}}, None, {"id": "b", "prov": None}])
    t = shredded(spark, [bare, "﻿" + bare, json.dumps(bare), json.dumps(json.dumps(bare)), "{broken", "", None, '"plain"', "[]"])
    assert {r["record"] for r in t["results"]} == {"0", "1", "2", "3"}
    assert sorted(r["pos"] for r in t["results"] if r["record"] == "2") == [0, 1, 2]
    assert [(r["pos"], r["page_no"]) for r in t["prov"] if r["record"] == "3"] == [(0, 3.0)]
    assert {r["record"] for r in t["document"]} == {"0", "1", "2", "3", "8"}


def test_empty_table(spark):
    assert shredded(spark, []) == {"document": []}


def test_latest_counts_ties_once(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("a", 2, "new"), ("b", None, "only"), (None, 3, "lost")], "id string, at int, v string")
    assert sorted(map(tuple, nested.latest(df, "id", "at", "v").collect())) == [("a", "new"), ("b", "only")]


def test_shared_and_recursive_elements_share_a_table():
    plan = nested.inline({("", "object"): 1, ("/node", "list"): 1, ("/node/*", "object"): 2, ("/node/*/name", "text"): 2, ("/node/*/node", "list"): 1, ("/node/*/node/*", "object"): 1, ("/node/*/node/*/name", "text"): 1})
    assert [(e.table, e.parent) for e in plan.edges] == [("node", "document"), ("node", "node")]
    assert plan.columns["node"] == {("name",): "text"}


def test_lists_and_maps_of_one_element_side_by_side(spark):
    docs = [{"results": [{"id": "a", "prov": [{"page_no": 1}]}, {"id": "b"}], "pages": [{"page_no": 5}]}, {"results": {"0": {"id": "c", "prov": {"0": {"page_no": 2}}}}, "pages": {"7": {"w": 1}}}, {"results": {"id": "d"}}]
    t = shredded(spark, [json.dumps(d) for d in docs])
    assert sorted((r["record"], r["pos"], r["id"]) for r in t["results"]) == [("0", 0, "a"), ("0", 1, "b"), ("1", 0, "c"), ("2", 0, "d")]
    assert sorted((r["record"], r["page_no"]) for r in t["prov"]) == [("0", 1.0), ("1", 2.0)]
    assert sorted((r["record"], r["key_"] or "", r["page_no"] or 0) for r in t["pages"]) == [("0", "", 5.0), ("1", "7", 0)]


def test_recursive_elements_keep_every_level(spark):
    doc = {"node": [{"name": "1", "kid": [{"v": 1}], "node": [{"name": "2", "kid": [{"v": 2}], "node": [{"name": "3", "kid": [{"v": 3}], "deep": True, "node": [{"name": "4"}]}]}]}]}
    t = shredded(spark, [json.dumps(doc)])
    assert sorted((r["name"], r["deep"]) for r in t["node"]) == [("1", None), ("2", None), ("3", True), ("4", None)]
    assert sorted(r["v"] for r in t["kid"]) == [1.0, 2.0, 3.0]
    assert {r["parent_id"] for r in t["kid"]} <= {r["node_id"] for r in t["node"]}
