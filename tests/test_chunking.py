import pytest
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import chunking, tables

SHAPE = "doc_id string, pos int, type string, markdown string, page int, bbox struct<l: double, t: double, r: double, b: double, coord_origin: string>"


def made(spark, items, limit=768):
    rows = [("d", i, kind, text, 1, None) for i, (kind, text) in enumerate(items)]
    return chunking.chunk_items(spark.createDataFrame(rows, SHAPE), limit).orderBy("chunk_index").collect()


def test_heading_goes_before_the_next_body(spark):
    out = made(spark, [("paragraph_title", "Scope"), ("text", "All buildings.")])
    assert [r["content"] for r in out] == ["Scope\n\nAll buildings."]


def test_headings_alone_give_nothing_and_the_last_of_several_counts(spark):
    assert made(spark, [("doc_title", "A"), ("paragraph_title", "B")]) == []
    assert made(spark, [("doc_title", "A"), ("paragraph_title", "B"), (None, "x")])[0]["content"] == "B\n\nx"


def test_furniture_and_blank_items_are_dropped(spark):
    out = made(spark, [("number", "1"), ("header", "H"), ("text", " \n"), ("text", None), ("footer", "F"), ("text", "Body")])
    assert [(r["content"], r["chunk_index"]) for r in out] == [("Body", 0)]


def test_table_rows_hang_from_a_whole_parent(spark):
    pipe = "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |"
    parent, one, two = made(spark, [("paragraph_title", "T"), ("text", pipe)])
    assert parent["type"] == "table" and not parent["searchable"] and parent["content"].startswith("T\n\n| a")
    assert [r["content"] for r in (one, two)] == ["| a | b |\n| 1 | 2 |", "| a | b |\n| 3 | 4 |"]
    assert {r["parent_chunk_id"] for r in (one, two)} == {parent["id"]} and one["parent_chunk_index"] == 0


def test_a_big_parent_stays_whole_but_long_text_is_cut(spark):
    row = "| " + " ".join(["word"] * 40) + " |"
    out = made(spark, [("table", "\n".join(["| h |", "|---|"] + [row] * 12))], limit=64)
    assert len(out) == 13 and out[0]["token_count"] > 64
    cut = made(spark, [("text", "A short sentence here. " * 200)], limit=64)
    assert len(cut) > 1 and all(r["token_count"] <= 64 and r["type"] == "text" for r in cut)


def test_one_data_row_is_searchable_as_a_whole(spark):
    out = made(spark, [("table", "<table><tr><th>A</th></tr><tr><td>1</td></tr></table>")])
    assert len(out) == 1 and out[0]["searchable"] and out[0]["content"] == "| A |\n| --- |\n| 1 |"


@pytest.mark.parametrize("limit", [1, 3, 5, 100])
def test_packing_matches_a_plain_fold(spark, limit):
    texts = ["One two. Three four five six! Seven?", "a b c d e f g h", "", "No end", "x. y. z. " * 5]

    def fold(text):
        done, cur, n, solo = [], [], 0, -1
        for i, s in enumerate(p.strip() for p in __import__("re").split(r"(?<=[.!?])\s+", text)):
            count = lambda t: len(__import__("regex").findall(T.TOKEN, t))
            units = [(w, i) for w in s.split()] if count(s) > limit else [(s, -1)] if s else []
            for u, k in units:
                if cur and (n + count(u) > limit or k != solo):
                    done.append(" ".join(cur))
                    cur, n = [], 0
                cur, n, solo = [*cur, u], n + count(u), k
        return done + ([" ".join(cur)] if cur else []) or [text]

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunking.pack(F.col("t"), limit).alias("p"))
    assert {r["t"]: r["p"] for r in df.collect()} == {t: fold(t) for t in texts}


def test_spans_fill_the_grid():
    html = "<table><tr><th>k</th><th>a</th><th>b</th></tr><tr><td rowspan='2'>x</td><td>1</td><td>2</td></tr><tr><td colspan='2'>3|4\n5</td></tr></table>"
    assert tables.html_to_pipes(html).split("\n") == ["| k | a | b |", "| --- | --- | --- |", "| x | 1 | 2 |", "| x | 3\\|4 5 | 3\\|4 5 |"]


def test_odd_html():
    assert tables.html_to_pipes("<table></table>") == "<table></table>"
    assert tables.html_to_pipes("<table><tr><td rowspan='0'>gone</td><td>kept</td></tr></table>").startswith("|  | kept |")
    nested = "<table><tr><td>a<table><tr><td>in</td></tr></table></td></tr><tr><td>b</td></tr></table>"
    assert tables.html_to_pipes(nested).split("\n")[0] == "| a in |"
    assert tables.html_rows("<table><tr><th>h</th></tr><tr><td>1</td></tr><tr><td>2</td></tr></table>") == ["h\n1", "h\n2"]
    assert tables.html_rows("<table><tr><td>1</td></tr></table>") == [] and tables.html_rows(None) == []


def test_ingest_status(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    chunks = spark.createDataFrame([("a",), ("a",)], "doc_id string")
    assert sorted(map(tuple, chunking.ingest_status(docs, chunks).collect())) == [("a", "completed", 2, None), ("b", "failed", 0, "no chunks")]


def test_truncation_keeps_what_stands_between(spark):
    df = spark.createDataFrame([("a, b  c!", n) for n in (0, 1, 2, 3, 9)], "t string, n int")
    got = [r[0] for r in df.select(T.truncate_tokens(F.col("t"), F.col("n"))).collect()]
    assert got == ["", "a", "a,", "a, b", "a, b  c!"]
