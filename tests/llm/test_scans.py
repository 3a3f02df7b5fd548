import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import scans as S


def test_years():
    assert S.repaired_year("2O24년에") == "2024년에" and S.repaired_year("Z016년") == "2016년" and S.repaired_year("14.03.2O25") == "14.03.2025"
    assert S.repaired_year("202l") == "2021" and S.repaired_year("2024년") is None and S.repaired_year("SOLO") is None and S.repaired_year(None) is None
    assert S.repaired_year("XV-2017") is None and S.repaired_year("1234") is None


def test_specks():
    assert S.without_specks("trosdr~altjalt") == "trosdraltjalt" and S.without_specks("w0rk") == "work" and S.without_specks("b@ckup") == "backup"
    for word in ("11일까지", "제30조에", "mg-116", "3,829원을", "plain", "10"):
        assert S.without_specks(word) is None


def test_running_lines_up_to_misread_characters(spark):
    running = spark.createDataFrame([("d", "yearlyreportnowhere"), ("d", "draft")] + [("e", f"chapter{chr(97 + i)}") for i in range(26)], "doc_id string, running string")
    forms = [("d", "yearlyreportnowherr"), ("d", "yeorlyrcportnowherr"), ("d", "yeorlyrcportnawherr"), ("d", "draff"), ("d", "goesonhere"), ("e", "chaptez"), ("e", "yearlyreportnowhere"), ("e", "chapterzz")]
    got = {(r["doc_id"], r["form"]) for r in S.like_running(spark.createDataFrame(forms, "doc_id string, form string"), running).collect()}
    assert got == {("d", "yearlyreportnowherr"), ("d", "yeorlyrcportnowherr"), ("d", "draff"), ("e", "chaptez"), ("e", "chapterzz")}


def test_rules_give_candidates(spark):
    words = spark.createDataFrame([("2O24년에",), ("w0rk",), ("plain",), ("co2",)], "seen string")
    assert {(r["seen"], r["meant"]) for r in S.ruled(words).collect()} == {("2O24년에", "2024년에"), ("w0rk", "work")}


def test_broken_words():
    words = S.words_of(["the insu-", "lation and Harb\xad", "our, self-", "assessment"], None, False)
    assert [w for w in words if w[3]] == [("", "insu", "lation", "-"), ("", "Harb", "our", "\xad"), ("", "self", "assessment", "-")]
    over = S.words_of(["it becomes pay¬"], "able to all", False)
    assert over[-1] == ("", "pay", "able", "¬")
    assert S.words_of(["able to all"], None, True) == [("to", "", "", ""), ("all", "", "", "")]
    assert S.words_of(["KE-", "Next"], None, False) == [("KE", "", "", ""), ("Next", "", "", "")]


def test_repaired_text():
    text = S.repaired_text(["The tcchnical insu-\nlation of", "2O20 goes\n- 4 -\non as self-\nassessment."], [[], [1]], {"self assessment": "self-assessment"}, {"tcchnical": "technical", "2O20": "2020"})
    assert text == "The technical insulation of 2020 goes on as self-assessment."


def page(doc, number, body, header=True):
    rows = [("header", "Yearly report of the office", 30.0, 48.0)] if header else []
    rows += [("text", b, 100.0 + 70 * k, 160.0 + 70 * k) for k, b in enumerate(body)]
    rows += [("number", f"- {number} -", 795.0, 806.0)]
    return [(doc, number, kind, md, t, b) for kind, md, t, b in rows]


@pytest.fixture(scope="module")
def scanned(spark):
    good = ["The technical office renews the annual insulation of every building in the district.", "Questions about the permanent register go to the planning board without delay."]
    rows = []
    for d in range(30):
        for n in range(1, 6):
            rows += page(f"d{d:02}", n, [good[0], good[1].replace("planning board", "planning\nboard")] if n != 3 else [good[0], "The board keeps the permanent"])
            if n == 3:
                rows += [(f"d{d:02}", 4, "text", "register of every annual building.", 80.0, 95.0)]
    rows.append(("d00", 6, "text", "The tcchnical office re¬\nnews the insu-\nlation in 2O24 for every bui~lding.", 100.0, 160.0))
    rows.append(("d00", 6, "text", None, 200.0, 260.0))
    rows.append(("d00", 6, "text", "  ", 200.0, 260.0))
    rows.append(("d00", 6, "header", "Questions about the register go to the office.", 200.0, 260.0))
    prov = "array<struct<page_no: int, bbox: struct<l: double, t: double, r: double, b: double, coord_origin: string>, charspan: array<string>>>"
    data = [(f"{d}-{i:04}", d, i, kind, md, [(n, (1.0, t, 2.0, b, "TOPLEFT"), [])], "x") for i, (d, n, kind, md, t, b) in enumerate(rows)]
    data += [data[0], ("odd", "d00", 9999, None, "No place at all is known of this last sentence.", [], "x")]
    return spark.createDataFrame(data, f"id string, doc_id string, item_no int, type string, markdown string, prov {prov}, role string")


def test_cases_of_a_small_corpus(spark, scanned):
    rows = scanned.collect()
    got = S.found(scanned).collect()
    of = lambda kind: {r["item_id"] for r in got if r["kind"] == kind}
    furniture = {r["id"] for r in rows if r["markdown"] and (r["markdown"].startswith("- ") or r["markdown"].startswith("Yearly"))}
    assert of("furniture") == furniture
    assert of("continued") == {r["id"] for r in rows if r["markdown"] == "The board keeps the permanent"}
    bad = next(r["id"] for r in rows if r["markdown"] and "tcchnical" in r["markdown"])
    assert {(r["kind"], r["word"]) for r in got if r["item_id"] == bad} == {("hyphen", "renews"), ("hyphen", "insulation"), ("misread", "technical"), ("misread", "2024"), ("misread", "building")}
    assert len(got) == len({tuple(r) for r in got})


def test_repaired_paragraphs(spark, scanned):
    out = {r["text"] for r in S.repaired(scanned.filter("doc_id <= 'd09'")).collect()}
    assert "The board keeps the permanent register of every annual building." in out
    assert not any("Yearly" in t or t.startswith("- ") for t in out)


def test_candidates_are_within_reach_and_complete(spark):
    lexicon = spark.createDataFrame([("technical", 50), ("insulation", 9), ("abc", 5), ("가나다라", 6)], "word string, n long")
    seen = spark.createDataFrame([("tcchnical",), ("insulatlon",), ("zzz",), ("가나다",), ("xtechnicalx",)], "seen string")
    got = {(r["seen"], r["meant"]) for r in S.candidates(seen, lexicon).collect()}
    assert got == {("tcchnical", "technical"), ("insulatlon", "insulation"), ("가나다", "가나다라"), ("xtechnicalx", "technical")}


def test_empty_table(spark, scanned):
    assert S.found(scanned.limit(0)).count() == 0
    assert S.found(scanned.filter(F.col("markdown").isNull())).count() == 0


def test_forms_of_broken_words_are_counted_by_one_join(spark, monkeypatch):
    seen = {}

    def fitted(df, features, label, name, *rest, fit_on):
        seen.update(judged=df, fit_on=fit_on)
        return df.withColumn(name, F.lit(1.0))

    monkeypatch.setattr(S, "_fitted", fitted)
    vocabulary = spark.createDataFrame([("e-mail", 3), ("garten", 5), ("gar", 2), ("ten", 1)], "word string, n bigint")
    broken = spark.createDataFrame([("e", "mail"), ("gar", "ten"), ("x", "y"), ("gar", "ten")], "left string, right string")
    whole = {(r["left"], r["right"], r["whole"]) for r in S.whole_words(broken, vocabulary).collect()}
    assert whole == {("e", "mail", "e-mail"), ("gar", "ten", "garten"), ("x", "y", "xy")}
    got = {(r["left"], *(round(np.expm1(r[c])) for c in ("h_joined", "h_kept", "h_left", "h_right"))) for r in seen["judged"].collect()}
    assert got == {("e", 0, 3, 0, 0), ("gar", 5, 0, 2, 1), ("x", 0, 0, 0, 0)}
    for df in seen.values():
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_what_a_classifier_is_fitted_on_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    rows = spark.range(200).selectExpr("cast(id as double) AS x", "cast(id % 2 as int) AS y", "cast(id as string) AS k")
    S._fitted(rows, ["x"], F.col("y") == 1, "p", S._trees(1), "k", fit_on=rows.mapInPandas(run, rows.schema))
    assert made.value == 200
