import numpy as np
from pyspark.sql import functions as F

from lodestack.operators import context, dense, fusion, glossary, metrics, sparse


def test_knn_against_brute_force_with_unusable_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(200)] + [(900, None), (901, [0.0] * 4), (902, [1.0, 2.0]), (903, [float("nan")] * 4)]
    stored = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = dense.knn(stored.filter("id < 20").select(F.col("id").alias("qid"), "embedding"), stored, 3)
    x = np.array([v for i, v in rows[:200]])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(20):
        s = np.round(u @ u[q], 6)
        want = sorted(range(200), key=lambda i: (-s[i], i))[:3]
        assert [r["id"] for r in got.filter(F.col("qid") == q).orderBy("rank").collect()] == want


def test_knn_ties_and_empty_tables(spark):
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in (5, 3, 9, 3)], "id long, embedding array<double>")
    query = spark.createDataFrame([("q", [2.0, 0.0])], "qid string, embedding array<double>")
    assert [r["id"] for r in dense.knn(query, same.distinct(), 2).orderBy("rank").collect()] == [3, 5]
    assert dense.knn(query, same.limit(0), 2).count() == 0
    assert dense.knn(query.limit(0), same, 2).count() == 0


def test_fusion_keeps_first_seen_order_on_ties(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "", 2)], "qid string, id string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", None, 3)], "qid string, id string, rank int")
    assert [r["id"] for r in fusion.reciprocal_rank_fusion([a, b], "id").orderBy("rank").collect()] == ["x", "y"]
    assert [r["id"] for r in fusion.reciprocal_rank_fusion([b, a], "id").orderBy("rank").collect()] == ["y", "x"]


def test_expansion_keeps_the_best_row_of_a_table(spark):
    hits = spark.createDataFrame(
        [("q", "r2", "row 2", "table_row", "p", 1, 0.9), ("q", "t", "text", "text", None, 2, 0.8), ("q", "r1", "row 1", "table_row", "p", 3, 0.7), ("q", "r9", "row 9", "table_row", "gone", 4, 0.6)],
        "qid string, chunk_id string, content string, type string, parent_chunk_id string, rank int, score double",
    )
    parents = spark.createDataFrame([("p", "whole table")], "id string, content string")
    out = [(r["chunk_id"], r["content"], r["type"], r["rank"], r["score"]) for r in fusion.expand_to_parents(hits, parents).orderBy("rank").collect()]
    assert out == [("p", "whole table", "table", 1, 0.9), ("t", "text", "text", 2, 0.8), ("r9", "row 9", "table_row", 3, 0.6)]


def test_boolean_match_needs_every_group(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red hen"), (3, "blue fox"), (4, None), (5, "")], "id int, t string")
    terms = spark.createDataFrame([("q", 0, "red"), ("q", 0, "blue"), ("q", 1, "fox")], "qid string, grp int, term string")
    assert sorted(r["id"] for r in sparse.boolean_match(terms, sparse.postings(docs, "id", "t"), "id").collect()) == [1, 3]


def test_rerank_and_budget(spark):
    hits = spark.createDataFrame([("q", "fox den", "a", "no match", 1), ("q", "fox den", "b", "the fox den", 2), ("q", "fox den", "c", None, 3)], "qid string, query string, id string, content string, rank int")
    assert [r["id"] for r in fusion.rerank(hits, 2).orderBy("rank").collect()] == ["b", "a"]
    cited = spark.createDataFrame([("q", 1, "f.pdf", 0, "one two three"), ("q", 2, "f.pdf", 2, "four five six"), ("q", 3, "f.pdf", 2, "never")], "qid string, rank int, filename string, page int, content string")
    fit = context.budgeted(cited, 26).orderBy("rank").collect()
    assert [r["kept_tokens"] for r in fit] == [3, 3] and fit[0]["header"] == "[1] Source: f.pdf" and fit[1]["header"].endswith("(page 2)")
    tight = context.budgeted(cited, 22).orderBy("rank").collect()
    assert [r["body"] for r in tight] == ["one two three"] or tight[-1]["kept_tokens"] < 3
    block = spark.createDataFrame([("q", "[Glossary]\n- a: b\n")], "qid string, block string")
    assert context.assembled(context.budgeted(cited, 40, block), block, 40).first()["context"].startswith("[Glossary]")


def test_answers_without_a_model(spark):
    df = spark.createDataFrame([("q", "why", " \n"), ("r", "why", "because")], "qid string, query string, context string")
    none, some = [r["answer"] for r in context.answered(df).orderBy("qid").collect()]
    assert "nothing was retrieved" in none and some.startswith("Retrieved for: why\n\nbecause")


def terms(spark):
    rows = [("1", " tax return ", ["filing", "", "tax return"], "yearly form", True), ("2", "filing", ["record"], None, True), ("3", "off", ["x"], "y", False), ("4", "tax", None, "levy", True)]
    return spark.createDataFrame(rows, "id string, standard_term string, synonyms array<string>, definition string, enabled boolean")


def test_surfaces_share_aliases_and_longest_wins(spark):
    known = {r["surface"]: (r["aliases"], r["standard"]) for r in glossary.surfaces(terms(spark)).collect()}
    assert known["filing"] == (["filing", "record", "tax return"], "tax return") and "x" not in known
    assert known["record"] == (["filing", "record"], "filing")
    queries = spark.createDataFrame([("a", "My TAX RETURN and tax, ok"), ("b", "STRASSE straße ß")], "qid string, query string")
    names = spark.createDataFrame([("tax return",), ("filing",), ("tax",), ("straße",)], "surface string")
    parts = {"a": [], "b": []}
    for r in glossary.segments(queries, names).orderBy("qid", "seg").collect():
        parts[r["qid"]].append((r["segment"], r["surface"]))
    assert parts["a"] == [("My ", None), ("TAX RETURN", "tax return"), (" and ", None), ("tax", "tax"), (", ok", None)]
    assert parts["b"][1] == ("straße", "straße")


def test_expansion_and_block(spark):
    queries = spark.createDataFrame([("q", "New filing rules"), ("n", None), ("b", " ")], "qid string, query string")
    known = glossary.surfaces(terms(spark))
    parts = glossary.segments(queries, known)
    groups = {}
    for r in glossary.expanded_terms(parts, known).collect():
        groups.setdefault(r["grp"], set()).add(r["term"])
    assert sorted(map(sorted, groups.values())) == [["filing", "record", "return", "tax"], ["new"], ["rules"]]
    block = glossary.glossary_block(glossary.matched_definitions(parts, known, glossary.definitions(terms(spark)))).collect()
    assert [(r["qid"], r["block"]) for r in block] == [("q", "[Glossary]\n- tax return: yearly form\n")]


def test_glossary_changes(spark):
    stored = spark.createDataFrame([("1", "a", ["x"], "c", "d", True), ("2", "b", None, None, None, True)], "id string, standard_term string, synonyms array<string>, category string, definition string, enabled boolean")
    incoming = spark.createDataFrame([("1", "a2", ["y"], "c", "d", True), ("9", "b", ["z"], None, None, False), ("5", "new", [], None, None, True)], stored.schema)
    out = {r["id"]: (r["standard_term"], r["action"]) for r in glossary.upsert(stored, incoming).collect()}
    assert out == {"1": ("a2", "updated"), "2": ("b", "updated"), "5": ("new", "inserted")}
    assert glossary.amended(stored, "1", category=None, definition="D").filter("id = '1'").first()["definition"] == "D"
    assert glossary.without(stored, "1").count() == 1


def test_metrics_by_hand(spark):
    results = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("s", "a", 1)], "qid string, id string, rank int")
    relevant = spark.createDataFrame([("q", "b"), ("q", "z"), ("t", "a")], "qid string, id string")
    got = {r["qid"]: (r["recall"], r["mrr"], r["ndcg"]) for r in metrics.per_query(results, relevant, 2).collect()}
    ideal = 1 + 1 / np.log2(3)
    assert got == {"q": (0.5, 0.5, round((1 / np.log2(3)) / ideal, 6)), "s": (0.0, 0.0, 0.0), "t": (0.0, 0.0, 0.0)}


def test_latency_and_gate(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 101)] + [("b", 5.0), ("c", None)], "g string, v double")
    got = {r["g"]: (r["n"], r["mean"], r["median"], r["p95"]) for r in metrics.latency(df, "g", "v").collect()}
    assert got == {"a": (100, 50.5, 50.5, 95.0), "b": (1, 5.0, 5.0, 5.0)}
    means = spark.createDataFrame([(0.8, None)], "f double, r double")
    assert {r["metric"]: r["passed"] for r in metrics.gate(means, {"f": 0.7, "r": 0.1}).collect()} == {"f": True, "r": False}


def test_lsh_finds_itself(spark):
    stored = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=8).tolist()) for i in range(50)], "id long, embedding array<double>")
    found = dense.lsh_candidates(stored.select(F.col("id").alias("qid"), "embedding"), stored)
    assert found.filter("qid = id").count() == 50


def test_lsh_recall(spark):
    units = np.random.default_rng(6).normal(size=(1500, 64))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    stored = spark.createDataFrame([(i, u.tolist()) for i, u in enumerate(units)], "id long, embedding array<double>")
    found = dense.lsh_candidates(stored.filter("id % 50 = 0").select(F.col("id").alias("qid"), "embedding"), stored, 5, exclude_self=True).collect()
    got = {(r["qid"], r["id"]) for r in found}
    scores = units @ units.T
    np.fill_diagonal(scores, -9)
    want = {(q, int(i)) for q in range(0, 1500, 50) for i in np.argsort(-scores[q])[:5]}
    assert len(found) == len(got) == 150 and len(want & got) >= 0.9 * len(want)
