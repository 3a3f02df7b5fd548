"""Repair of text from scanned pages.

Items of a scanned document are put back into continuous paragraphs:

* Page furniture (running headers and footers, page numbers) is told from text
  by gradient-boosted trees over an item's place, form and repetition in its
  document. They are fitted on the parser's own types, which are often wrong
  but right more often than not, so the majority of like items decides.
  Titles are told from paragraphs in the same way.
* Line-pair classifiers decide whether a paragraph goes on in the next one
  (fitted on paragraphs cut in two and on whole neighbours), whether a line
  inside a paragraph is furniture (fitted on undisturbed lines and on furniture
  put between them) and whether the hyphen of a broken word belongs to it
  (fitted on words cut at random and at their own hyphens).
* Misrecognised words get correction candidates through an inverted join of
  character bigrams with their places; years read as letters and words with
  specks or stray digits, whose right form may stand nowhere else, get theirs
  by rule. Gradient-boosted trees, fitted on words and years that were damaged
  on purpose and on undamaged ones, choose among all of them.

Counts and statistics cover all items; only the classifiers are fitted on
bounded samples (FIT_ROWS rows each).

Defined results: null and blank items are no cases and carry no text; repeated
rows of an item count once; items without a page or a box keep their reading
order; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.session import checkpointed

#: Rows that a classifier is fitted on, at most.
FIT_ROWS = 20_000
#: A word that occurs so often is taken as rightly spelt.
SURE = 4
#: From so many times a word's count on, a like word is what it should have been, however often it was misread.
FREQUENT = 50
# Forms of page numbers, signs of a broken word, and what scanners confuse (seen -> meant).
PAGE_NUMBER = r"^\s*(?:[-–·\[(]?\s*[0-9OolI]{1,4}\s*[-–·\])]?|[0-9OolI]+ ?/ ?[0-9OolI]+|(?:p\.|page|seite|s\.) ?[0-9OolI]+|제? ?[0-9OolI]+ ?쪽|[ivxlc]{1,7})\s*$"
BREAKS = "-¬‐\xad"
CONFUSED = {
    "c": "e", "e": "c", "f": "t", "u": "n", "n": "u", "l": "i", "5": "s", "@": "a", "1": "l", "0": "o",
    "cl": "d", "q": "g", "b": "h", "ii": "u", "6": "b", "rn": "m", "vv": "w",
}
SPECKS = "~|·`^'"
LETTERS_OF_DIGITS = tuple(zip("OoZzlISsbBqgQ", "0022115568990", strict=True))
DIGIT_LIKE = str.maketrans(dict(LETTERS_OF_DIGITS))
FURNITURE = ("header", "footer", "number")
TITLES = ("doc_title", "paragraph_title")

YEAR_LIKE = r"(?<![A-Za-z0-9])([0-9OoZzlISsbBqg]{4})(?![A-Za-z0-9])"
_year = re.compile(YEAR_LIKE)
_whole_year = re.compile(r"(?<![A-Za-z0-9])(?:19|20)[0-9]{2}(?![A-Za-z0-9])")
_edges = re.compile(r"^[^\w~|·`^'@]+|[^\w~|·`^'@]+$")


# ------------------------------------------------------------------- items


def items(df: DataFrame) -> DataFrame:
    """One row per item, with its place on the page and its neighbours in reading order."""
    first, last = F.get("prov", F.lit(0)), F.try_element_at("prov", F.lit(-1))
    rows = df.select(
        "id", "doc_id", "item_no", F.col("type").alias("kind"), F.col("markdown").alias("md"),
        first["page_no"].alias("page"), last["page_no"].alias("last_page"), first["bbox"]["t"].alias("top"), first["bbox"]["b"].alias("bottom"), F.size(F.coalesce("prov", F.array())).alias("places"),
    ).filter(F.col("md").isNotNull() & F.col("md").rlike(r"(?U)\S") & F.col("id").isNotNull())
    rows = rows.repartition("doc_id").dropDuplicates(["doc_id", "id"])
    order = Window.partitionBy("doc_id").orderBy("item_no", "id")
    lines = F.size(F.split("md", "\n"))
    one = F.trim(F.col("md"))
    form = F.lower(F.regexp_replace(one, r"[^\p{L}]+", ""))
    rows = (
        rows.withColumn("page", F.coalesce("page", F.last("page", True).over(order), F.lit(1)))
        .withColumn("form", F.when((lines == 1) & (F.length(one) <= 120) & (F.length(form) > 3), form))
        .withColumn("first_on_page", F.coalesce(F.lag("page").over(order) != F.col("page"), F.lit(True)).cast("double"))
        .withColumn("last_on_page", F.coalesce(F.lead("page").over(order) != F.col("page"), F.lit(True)).cast("double"))
        .withColumn("like", F.when(F.col("form").isNotNull(), F.count("*").over(Window.partitionBy("doc_id", "form"))).otherwise(1))
    )
    letters = F.length(F.regexp_replace(one, r"[^\p{L}]", ""))
    return (
        rows.withColumn("is_table", one.startswith("|") | one.rlike("(?i)^<table"))
        .withColumn("f_lines", F.least(lines, F.lit(10)).cast("double"))
        .withColumn("f_length", F.least(F.length(one), F.lit(400)).cast("double"))
        .withColumn("f_letters", letters / F.greatest(F.length(one), F.lit(1)))
        .withColumn("f_number", one.rlike("(?i)" + PAGE_NUMBER).cast("double"))
        .withColumn("f_page_at_edge", one.rlike(r"^\S{1,4}\s{2,}\S|\S\s{2,}\S{1,4}$").cast("double"))
        .withColumn("f_ends", one.rlike(r"[.?!:;。？！]\W*$").cast("double"))
        .withColumn("f_numbered", one.rlike(r"^\d+\. \S+( \S+){0,3}$").cast("double"))
        .withColumn("f_top", F.coalesce("top", F.lit(-100.0)))
        .withColumn("f_height", F.coalesce(F.col("bottom") - F.col("top"), F.lit(-100.0)))
        .withColumn("f_like", F.log1p("like"))
        .withColumn("f_start", (F.col("item_no") == 0).cast("double"))
    )


FEATURES = ["f_lines", "f_length", "f_letters", "f_number", "f_page_at_edge", "f_ends", "f_numbered", "f_top", "f_height", "f_like", "f_start", "first_on_page", "last_on_page"]


def _bounded(df: DataFrame, key: Column | str, rows: int = FIT_ROWS) -> DataFrame:
    """A hash sample of at most about ``rows`` rows; ``key`` is what is hashed, or a column that holds the hash."""
    n = df.count()
    mark = F.xxhash64(key) if isinstance(key, str) else key
    return df if n <= rows else df.filter(F.pmod(mark, F.lit(1 << 20)) < int((1 << 20) * rows / n))


def _fitted(df: DataFrame, features: list[str], label, name: str, learner, sample_by: str, fit_on: DataFrame | None = None) -> DataFrame:
    """``df`` with the probability ``name`` of a classifier fitted on a bounded sample of ``fit_on`` (or ``df``).

    ``fit_on`` may take many joins, so it is made once for its count and its
    sample; every exchange also costs the driver a thread and compiled code.
    """
    pick = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep")
    known = (df if fit_on is None else fit_on).select(*features, label.cast("double").alias("__y"), F.xxhash64(sample_by).alias("__k"))
    known = known if fit_on is None else checkpointed(known)
    train = pick.transform(_bounded(known, F.col("__k"))).select("__x", "__y")
    train = checkpointed(train.repartition(2))  # a bounded sample: many small tasks would cost more than its rows
    classes = {r["__y"] for r in train.select("__y").distinct().collect()}
    if classes != {0.0, 1.0}:
        return df.withColumn(name, F.lit(1.0 if classes == {1.0} else 0.0))
    model = learner.copy().setFeaturesCol("__x").setLabelCol("__y").setProbabilityCol("__p").setRawPredictionCol("__r").setPredictionCol("__c").fit(train)
    return model.transform(pick.transform(df)).withColumn(name, vector_to_array("__p")[1]).drop("__x", "__p", "__r", "__c")


def _trees(rounds: int = 12) -> GBTClassifier:
    return GBTClassifier(maxIter=rounds, maxDepth=4, seed=5, stepSize=0.2, minInstancesPerNode=25)


def running_lines(furniture: DataFrame) -> DataFrame:
    """The different furniture texts of each document, digits and punctuation left out: (doc_id, running)."""
    return furniture.filter(F.col("form").isNotNull()).select("doc_id", F.col("form").alias("running")).distinct()


def like_running(forms: DataFrame, running: DataFrame) -> DataFrame:
    """The (doc_id, form) that are a running line of their document up to some misread characters, one in six and at least two.

    A running line is cut into one piece more than edits are allowed, so one
    piece is whole in every form in reach, not further from its place than
    there are edits. Forms and lines meet by document and piece, whatever their
    number, and are then compared.
    """
    edits = F.greatest(F.lit(2), F.floor(F.length("running") / 6)).cast("int")
    n = F.length("running")
    cut = running.select("doc_id", "running", edits.alias("edits")).select("*", F.explode(F.sequence(F.lit(0), F.col("edits"))).alias("i"))
    start = F.floor(F.col("i") * n / (F.col("edits") + 1)).cast("int")
    end = F.floor((F.col("i") + 1) * n / (F.col("edits") + 1)).cast("int")
    pieces = cut.select("doc_id", "running", "edits", start.alias("start"), F.substr("running", start + 1, end - start).alias("piece")).filter(F.col("piece") != "")
    own = running.select("doc_id", F.col("running").alias("form"))
    reach = running.select("doc_id", n.alias("n"), edits.alias("edits")).groupBy("doc_id").agg(F.min(F.col("n") - F.col("edits")).alias("low"), F.max(F.col("n") + F.col("edits")).alias("high"))
    given = forms.select("doc_id", "form").distinct()
    others = given.join(own, ["doc_id", "form"], "left_anti").join(reach, "doc_id").filter(F.length("form").between(F.col("low"), F.col("high"))).select("doc_id", "form")
    # a line of n letters is cut into pieces of n / (edits + 1)
    sizes = F.when(F.length("form") >= 36, F.array(*map(F.lit, (5, 6)))).when(F.length("form") >= 14, F.array(*map(F.lit, (4, 5, 6)))).otherwise(F.array(*map(F.lit, (1, 2, 3, 4, 5))))
    spots = others.withColumn("size", F.explode(sizes)).filter(F.col("size") <= F.length("form"))
    spots = spots.withColumn("at", F.explode(F.sequence(F.lit(0), F.length("form") - F.col("size"))))
    probes = spots.select("doc_id", "form", "at", F.substr("form", F.col("at") + 1, F.col("size")).alias("piece"))
    near = F.abs(F.col("at") - F.col("start")) <= F.col("edits")
    met = probes.join(pieces, ["doc_id", "piece"]).filter(near & (F.abs(n - F.length("form")) <= F.col("edits"))).select("doc_id", "form", "running", "edits").distinct()
    return met.filter(F.levenshtein("form", "running") <= F.col("edits")).select("doc_id", "form").distinct().unionByName(given.join(own, ["doc_id", "form"], "left_semi"))


def classified(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with ``role`` (furniture, title, table or paragraph), and the running lines of each document.

    Furniture is told twice: the first time shows each document's running
    lines, and likeness to one of them, misread characters allowed, helps the
    second time where an item has no box.
    """
    rows = checkpointed(items(df))
    text = rows.filter(~F.col("is_table"))
    is_furniture = F.coalesce(F.col("kind").isin(*FURNITURE), F.lit(False))
    text = checkpointed(_fitted(text, FEATURES, is_furniture, "p_first", _trees(), "id"))
    running = checkpointed(running_lines(text.filter(F.col("p_first") >= 0.5)))
    alike = like_running(text.filter(F.col("form").isNotNull()), running).withColumn("f_running", F.lit(1.0))
    text = checkpointed(text.join(alike, ["doc_id", "form"], "left").fillna({"f_running": 0.0}))
    text = _fitted(text, [*FEATURES, "f_running"], is_furniture, "p_furniture", _trees(), "id")
    rest = text.filter(F.col("p_furniture") < 0.5)
    text = _fitted(text, FEATURES, F.coalesce(F.col("kind").isin(*TITLES), F.lit(False)), "p_title", _trees(), "id", fit_on=rest)
    role = F.when(F.col("p_furniture") >= 0.5, "furniture").when(F.col("p_title") >= 0.5, "title").otherwise("paragraph")
    text = text.withColumn("role", role).drop("p_first", "p_furniture", "p_title", "f_running")
    return text.unionByName(rows.filter(F.col("is_table")).withColumn("role", F.lit("table"))), running


# --------------------------------------------------------------- line pairs

PAIR_FEATURES = ["j_ends", "j_broken", "j_lower", "j_upper", "j_digit", "j_hangul", "j_words", "j_next_words", "height", "next_height"]


def _pair_features(df: DataFrame, before: str, after: str) -> DataFrame:
    """Features of a pair of texts of which the second may go on where the first stops."""
    return (
        df.withColumn("j_ends", F.col(before).rlike(r"[.?!。？！][\"”’)\]]*\s*$").cast("double"))
        .withColumn("j_broken", F.col(before).rlike(r"\p{L}[-¬‐­]\s*$").cast("double"))
        .withColumn("j_lower", F.col(after).rlike(r"^\s*\p{Ll}").cast("double"))
        .withColumn("j_upper", F.col(after).rlike(r"^\s*\p{Lu}").cast("double"))
        .withColumn("j_digit", F.col(after).rlike(r"^\s*\d").cast("double"))
        .withColumn("j_hangul", F.col(after).rlike(r"^\s*[가-힣]").cast("double"))
        .withColumn("j_words", F.least(F.regexp_count(before, F.lit(r"\S+")), F.lit(12)).cast("double"))
        .withColumn("j_next_words", F.least(F.regexp_count(after, F.lit(r"\S+")), F.lit(12)).cast("double"))
    )


def followed(roles: DataFrame) -> DataFrame:
    """Paragraphs with the next one in reading order, and whether they go on there.

    Furniture doesn't stand between; a title or a table does.
    """
    order = Window.partitionBy("doc_id").orderBy("item_no", "id")
    body = roles.filter(F.col("role") != "furniture")
    nxt = lambda c: F.lead(c).over(order)
    rows = body.select(
        "id", "doc_id", "item_no", "role", "md", "places", "page", F.coalesce("last_page", "page").alias("last_page"),
        nxt("id").alias("next_id"), nxt("role").alias("next_role"), nxt("md").alias("next_md"), nxt("page").alias("next_page"),
        F.col("f_height").alias("height"), F.coalesce(nxt("f_height"), F.lit(-100.0)).alias("next_height"),
    ).filter(F.col("role") == "paragraph")
    rows = checkpointed(rows)
    whole = rows.filter((F.col("next_role") == "paragraph") & (F.col("next_page") == F.col("last_page"))).select("id", F.col("md").alias("a"), F.col("next_md").alias("b"), "height", "next_height", F.lit(0).alias("goes_on"))
    words = F.split(F.regexp_replace("md", r"\s+", " "), " ")
    middle = (F.pmod(F.xxhash64("id"), F.size("w") - 3) + 1).cast("int")
    cut = rows.withColumn("w", words).filter((F.size("w") >= 8) & (F.col("md").rlike(r"[.?!]\s*$"))).withColumn("m", middle)
    cut = cut.select("id", F.array_join(F.slice("w", 1, F.col("m")), " ").alias("a"), F.array_join(F.slice("w", F.col("m") + 1, 1000), " ").alias("b"), "height", F.col("height").alias("next_height"), F.lit(1).alias("goes_on"))
    fit_on = _pair_features(whole.unionByName(cut), "a", "b")
    judged = _pair_features(rows.fillna({"next_md": ""}), "md", "next_md")
    judged = _fitted(judged, PAIR_FEATURES, F.col("goes_on") == 1, "p_on", _trees(), "a", fit_on=fit_on)
    on = (F.col("next_role") == "paragraph") & (F.col("next_page") > F.col("page")) & (F.col("next_page") >= F.col("last_page")) & (F.col("p_on") >= 0.5)
    return judged.withColumn("goes_on", F.coalesce(on, F.lit(False)))


LINE_FEATURES = ["l_number", "l_running", "l_length", "l_letters", "l_ends", "l_lower", "j_ends", "j_broken", "j_lower", "j_upper", "j_digit", "j_hangul"]


def _line_features(df: DataFrame) -> DataFrame:
    """Features of a ``line`` between two others: its own, and those of the pair that would meet without it."""
    one = F.trim("line")
    return (
        _pair_features(df, "before", "after")
        .withColumn("l_number", one.rlike("(?i)" + PAGE_NUMBER).cast("double"))
        .withColumn("l_length", F.least(F.length(one), F.lit(200)).cast("double"))
        .withColumn("l_letters", F.length(F.regexp_replace(one, r"[^\p{L}]", "")) / F.greatest(F.length(one), F.lit(1)))
        .withColumn("l_ends", one.rlike(r"[.?!:;。？！]\W*$").cast("double"))
        .withColumn("l_lower", one.rlike(r"^\p{Ll}").cast("double"))
    )


def inside_lines(paragraphs: DataFrame, roles: DataFrame, running: DataFrame) -> DataFrame:
    """Numbers of the lines inside a paragraph that are furniture: (id, inside).

    A line-pair classifier decides for every line between two others of a
    paragraph that stands on several places. It is fitted on lines of
    paragraphs at one place, and on furniture put between such lines.
    """
    split = checkpointed(paragraphs.select("id", "doc_id", "places", F.split("md", "\n").alias("lines")).filter(F.size("lines") >= 3))
    split = split.filter(F.col("places") > 1).unionByName(_bounded(split.filter(F.col("places") <= 1), "id", FIT_ROWS // 4))
    lines = split.select("id", "doc_id", "places", "lines", F.explode(F.sequence(F.lit(1), F.size("lines") - 2)).alias("number"))
    lines = lines.select("id", "doc_id", "places", "number", *[F.get("lines", F.col("number") + step).alias(name) for name, step in (("before", -1), ("line", 0), ("after", 1))])
    form = F.lower(F.regexp_replace("line", r"[^\p{L}]+", ""))
    lines = lines.withColumn("form", F.when((F.length(F.trim("line")) <= 120) & (F.length(form) > 3), form))
    alike = like_running(lines.filter(F.col("form").isNotNull()), running).withColumn("l_running", F.lit(1.0))
    lines = checkpointed(_line_features(lines.join(alike, ["doc_id", "form"], "left").fillna({"l_running": 0.0})))
    plain = _bounded(lines.filter(F.col("places") <= 1), "id", FIT_ROWS // 2)
    put = _bounded(roles.filter((F.col("role") == "furniture") & ~F.col("md").contains("\n")).select("id", F.col("md").alias("line"), F.col("form").isNotNull().cast("double").alias("l_running")), "id", FIT_ROWS // 2)
    nth = lambda df: df.withColumn("nth", F.row_number().over(Window.orderBy(F.xxhash64("id"))))  # noqa: E731  (bounded samples)
    put = _line_features(nth(put).join(nth(plain).select("nth", "before", "after"), "nth"))
    columns = ["line", *LINE_FEATURES]
    fit_on = plain.select(*columns, F.lit(0).alias("put")).unionByName(put.select(*columns, F.lit(1).alias("put")))
    judged = _fitted(lines.filter(F.col("places") > 1), LINE_FEATURES, F.col("put") == 1, "p_inside", _trees(), "line", fit_on=fit_on)
    return judged.filter(F.col("p_inside") >= 0.5).groupBy("id").agg(F.array_sort(F.collect_set("number")).alias("inside"))


# ---------------------------------------------------------- lines and words


def words_of(lines: list[str], following: str | None, skip_first: bool) -> list[tuple[str, str, str, str]]:
    """Words (word, left, right, mark) of a paragraph's clean lines; ``left``, ``right`` and ``mark`` of a broken one.

    ``following`` is the text in which the paragraph goes on; ``skip_first``
    tells that the first word belongs to the paragraph before.
    """
    out, carried = [], None
    texts = [*lines, *([following.split("\n")[0]] if following else [])]
    for number, line in enumerate(texts):
        tokens = line.split()
        if number == 0 and skip_first:
            tokens = tokens[1:]
        if carried and tokens:
            left, mark = carried
            right = _edges.sub("", tokens[0])
            if right[:1].islower():
                out.append(("", left, right, mark))
                tokens = tokens[1:]
            else:
                out.append((left, "", "", ""))
        carried = None
        if number == len(lines):
            break
        if tokens and len(tokens[-1]) > 1 and tokens[-1][-1] in BREAKS and tokens[-1][-2].isalpha():
            carried = _edges.sub("", tokens[-1][:-1]), tokens[-1][-1]
            tokens = tokens[:-1]
        for token in tokens:
            for part in re.split(r"(?<=[가-힣])[.?](?=\S)", token):
                word = _edges.sub("", part)
                if word:
                    out.append((word, "", "", ""))
    return out


def page_words(paragraphs: DataFrame) -> DataFrame:
    """One row (id, word, left, right, mark) per word of a paragraph, its ``inside`` lines left out."""

    def run(batches):
        for batch in batches:
            rows = []
            for item, md, inside, following, skip in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                lines = [x for i, x in enumerate(md.split("\n")) if i not in (inside or ())]
                rows += [(item, *w) for w in words_of(lines, following, skip)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["id", "word", "left", "right", "mark"])

    shape = paragraphs.select("id", "md", "inside", F.when(F.col("goes_on"), F.col("next_md")).alias("following"), "skip_first")
    return shape.mapInArrow(run, "id string, word string, left string, right string, mark string")


# ------------------------------------------------------------------ spelling


def repaired_year(word: str | None) -> str | None:
    """A year with what is attached to it whose digits were read as letters, put right; null if the word isn't one."""
    for found in _year.finditer(word or ""):
        seen = found.group(1)
        meant = seen.translate(DIGIT_LIKE)
        if meant != seen and meant[:2] in ("19", "20") and sum(c.isdigit() for c in seen) >= 2:
            return (word[: found.start()] + meant + word[found.end() :]).lower()
    return None


def without_specks(word: str) -> str | None:
    """A word without the specks inside it, or with the letters that single stray digits stand for; null if there are none.

    This is for words that occur nowhere else; numbers, codes and what hangs
    from them are left alone.
    """
    plain = re.sub(rf"(?<=[^\W\d_])[{re.escape(SPECKS)}](?=[^\W\d_])", "", word)
    if word.isascii() or not re.search("[가-힣]", word):
        plain = re.sub(r"(?<=[^\W\d_])[@0156](?=[^\W\d_])|^[@0156](?=[^\W\d_]{3})|(?<=[^\W\d_]{3})[@0156]$", lambda m: CONFUSED[m.group()], plain)
    return plain if plain != word and len(plain) > 3 and plain.replace("-", "").isalpha() else None


def _change(seen: str, meant: str) -> tuple[str, str, int, int]:
    """What differs between two words, and how many characters before and after it agree."""
    head = 0
    while head < min(len(seen), len(meant)) and seen[head] == meant[head]:
        head += 1
    tail = 0
    while tail < min(len(seen), len(meant)) - head and seen[-1 - tail] == meant[-1 - tail]:
        tail += 1
    return seen[head : len(seen) - tail], meant[head : len(meant) - tail], head, tail


SPELL_FEATURES = ["s_seen", "s_meant", "s_confused", "s_speck", "s_letters", "s_digit", "s_head", "s_tail", "s_length", "s_rule", "s_count"]
_SPELL = "s_seen double, s_meant double, s_confused double, s_speck double, s_letters double, s_digit double, s_head double, s_tail double, s_length double"


def _spell_rows(seen: pd.Series, meant: pd.Series) -> pd.DataFrame:
    rows = []
    for s, m in zip(seen, meant, strict=True):
        a, b, head, tail = _change(s, m)
        confused = CONFUSED.get(a) == b or (len(a) == len(b) == 1 and b.isalpha() and not a.isalpha())
        rows.append((len(a), len(b), confused, bool(a) and all(c in SPECKS for c in a) and not b, a.isalpha() or not a, b.isdigit(), min(head, 3), min(tail, 3), len(m)))
    return pd.DataFrame(rows, columns=SPELL_FEATURES[:-2], dtype="float64")


def ruled(words: DataFrame) -> DataFrame:
    """Candidates (seen, meant) for words that needn't occur rightly anywhere: years without letters, words without specks and stray digits."""

    def run(batches):
        for batch in batches:
            pairs = [(w, m) for w in batch.column(0).to_pylist() for m in (repaired_year(w), without_specks(w.lower())) if m]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["seen", "meant"])

    odd = words.select("seen").filter(F.col("seen").rlike(r"[0-9@~|·`^']")).distinct()
    return odd.mapInArrow(run, "seen string, meant string").distinct()


def damaged(words: DataFrame, copies: int = 2) -> DataFrame:
    """Rightly spelt words damaged on purpose: (seen, meant)."""
    inverse: dict[str, list[str]] = {}
    for seen, meant in CONFUSED.items():
        inverse.setdefault(meant, []).append(seen)

    def run(batches):
        for batch in batches:
            seen, meant = [], []
            for word in batch.column(0).to_pylist():
                rng = np.random.default_rng(list(word.encode()))
                year = _whole_year.search(word)
                for _ in range(copies):
                    if year:
                        i = int(rng.integers(year.start(), year.end()))
                        likely = [a for a, b in LETTERS_OF_DIGITS if b == word[i]]
                        if likely:
                            seen.append(word[:i] + likely[rng.integers(len(likely))] + word[i + 1 :])
                            meant.append(word)
                        continue
                    spots = [(i, s) for i, c in enumerate(word) for s in inverse.get(c, ())]
                    if spots and rng.random() < 0.7:
                        i, s = spots[rng.integers(len(spots))]
                        bad = word[:i] + s + word[i + 1 :]
                    else:
                        i = int(rng.integers(1, len(word)))
                        bad = word[:i] + SPECKS[rng.integers(len(SPECKS))] + word[i + (rng.random() < 0.15) :]
                    seen.append(bad)
                    meant.append(word)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array(meant, pa.string())], names=["seen", "meant"])

    return words.select("word").mapInArrow(run, "seen string, meant string")


def _grams(word: str, length: str) -> DataFrame:
    padded = F.concat(F.lit("^"), F.col(word), F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.col(length) + 1), lambda i: F.struct(i.alias("place"), F.substr(padded, i, F.lit(2)).alias("gram")))


def candidates(seen: DataFrame, lexicon: DataFrame, edits: int = 2) -> DataFrame:
    """Rightly spelt words within ``edits`` edits of each ``seen`` word: (seen, meant, n).

    An edit touches at most two bigrams, so of any ``2 * edits + 1`` bigrams of
    a seen word a word in reach has one, moved by the letters that were added
    or lost before it. The rarest are looked up by gram, place and length
    together, so even the words of a very frequent gram are met in small groups.
    """
    listed = lexicon.select(F.col("word").alias("meant"), "n", F.length("word").alias("length"))
    postings = listed.select("meant", "n", "length", F.explode(_grams("meant", "length")).alias("g")).select("meant", "n", "length", "g.gram", "g.place")
    moves = [(shift, longer) for shift in range(-edits, edits + 1) for longer in range(-edits, edits + 1) if abs(shift) + abs(longer - shift) <= edits]
    moved = F.explode(F.array(*[F.struct((F.col("place") - shift).alias("place"), (F.col("length") - longer).alias("size")) for shift, longer in moves])).alias("m")
    spread = postings.groupBy("gram").agg(F.count("*").alias("df"))
    asked = seen.select("seen").distinct().withColumn("size", F.length("seen"))
    probes = asked.select("seen", "size", F.explode(_grams("seen", "size")).alias("g")).select("seen", "size", "g.gram", "g.place").join(spread, "gram", "left").fillna({"df": 0})
    rarest = Window.partitionBy("seen").orderBy("df", "gram", "place")
    probes = probes.withColumn("nth", F.row_number().over(rarest)).filter((F.col("nth") <= 2 * edits + 1) & (F.col("df") > 0))
    met = probes.select("seen", "gram", "place", "size").join(postings.select("meant", "n", "gram", moved).select("meant", "n", "gram", "m.*"), ["gram", "place", "size"])
    pairs = met.select("seen", "meant", "n").distinct()
    return pairs.filter((F.col("seen") != F.col("meant")) & (F.levenshtein("seen", "meant", edits) >= 0))


def corrections(vocabulary: DataFrame) -> DataFrame:
    """The chosen correction (seen, meant) of every misrecognised word of ``vocabulary`` (word, n).

    Candidates come from the inverted join, and from rules for what needn't
    occur rightly anywhere; the trees choose among all of them. Of the joined
    ones only a much more frequent word can be what was meant: FREQUENT times
    as frequent, or, for words seen fewer than SURE times, at least SURE times.
    """
    shaped = F.col("word").rlike(r"^\p{L}[\p{L}]*(-\p{L}+)*$")
    sure = checkpointed(vocabulary.filter((F.col("n") >= SURE) & shaped & (F.length("word") >= 2)))
    heard = vocabulary.filter(F.length("word") >= 3).select(F.col("word").alias("seen"), F.col("n").alias("times"))
    learn = checkpointed(_bounded(sure.filter(F.length("word") >= 4), "word", FIT_ROWS // 4))
    years = _bounded(vocabulary.filter(F.col("word").rlike(r"(?<![A-Za-z0-9])(19|20)[0-9]{2}(?![A-Za-z0-9])")), "word", FIT_ROWS // 8)
    bad = checkpointed(damaged(learn.select("word").unionByName(years.select("word"))).distinct())
    every = checkpointed(heard.select("seen").unionByName(bad.select("seen")).distinct())
    schema = "seen string, meant string, n bigint, s_rule double, " + _SPELL

    def features(frames):
        for frame in frames:
            yield pd.concat([frame.reset_index(drop=True), _spell_rows(frame["seen"], frame["meant"])], axis=1)

    by_rule = ruled(every).join(vocabulary.select(F.col("word").alias("meant"), "n"), "meant", "left").fillna({"n": 0}).select("seen", "meant", "n", F.lit(1.0).alias("s_rule"))
    joined = candidates(every, sure).select("seen", "meant", "n", F.lit(0.0).alias("s_rule"))
    met = joined.unionByName(by_rule).groupBy("seen", "meant").agg(F.max("n").alias("n"), F.max("s_rule").alias("s_rule"))
    pairs = checkpointed(met.mapInPandas(features, schema).withColumn("s_count", F.least(F.log1p("n"), F.lit(8.0))))
    truth = bad.withColumn("right", F.lit(1))
    spoilt = pairs.join(bad.select("seen").distinct(), "seen").join(truth, ["seen", "meant"], "left")
    # a candidate by rule stands twice: also as if the right word stood nowhere else
    spoilt = spoilt.withColumn("s_count", F.explode(F.when(F.col("s_rule") == 1, F.array("s_count", F.lit(0.0))).otherwise(F.array("s_count"))))
    rests = pairs.join(learn.select(F.col("word").alias("seen"), F.col("n").alias("times")), "seen").filter(F.col("n") < FREQUENT * F.col("times"))
    codes = pairs.filter(F.col("s_rule") == 1).join(heard.filter(F.col("times") >= SURE), "seen").filter(F.col("n") < F.col("times"))
    intact = rests.unionByName(codes).drop("times").withColumn("right", F.lit(0))
    fit_on = spoilt.unionByName(intact)
    rarer = ((F.col("times") < SURE) & (F.col("n") >= F.greatest(F.lit(SURE), 2 * F.col("times")))) | (F.col("n") >= FREQUENT * F.col("times")) | (F.col("s_rule") == 1)
    real = pairs.join(heard, "seen").filter(rarer).drop("times")
    judged = _fitted(real, SPELL_FEATURES, F.coalesce(F.col("right"), F.lit(0)), "p_right", _trees(), "seen", fit_on=fit_on)
    best = Window.partitionBy("seen").orderBy(F.desc(F.round("p_right", 2)), F.desc("n"), "meant")
    return judged.filter(F.col("p_right") >= 0.5).withColumn("nth", F.row_number().over(best)).filter(F.col("nth") == 1).select("seen", "meant")


def whole_words(broken: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The whole word of every broken one: (left, right, whole). A classifier decides whether the hyphen stays."""
    counts = vocabulary.select("word", F.log1p("n").alias("c"))

    def counted(df: DataFrame) -> DataFrame:
        """Different rows, with the counts of the four forms from one join."""
        forms = {"h_joined": F.concat("left", "right"), "h_kept": F.concat_ws("-", "left", "right"), "h_left": F.col("left"), "h_right": F.col("right")}
        each = df.withColumn("form", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), word.alias("word")) for name, word in forms.items()])))
        met = each.select(*df.columns, "form.*").join(counts, "word", "left")
        return met.groupBy(*df.columns).agg(*[F.coalesce(F.max(F.when(F.col("name") == name, F.col("c"))), F.lit(0.0)).alias(name) for name in forms])

    known = _bounded(vocabulary.filter((F.col("n") >= 2) & (F.length("word") >= 5)), "word")
    hyphened = known.filter(F.col("word").rlike(r"^\p{L}{2,}-\p{L}{2,}$")).select(F.substring_index("word", "-", 1).alias("left"), F.substring_index("word", "-", -1).alias("right"), F.lit(1).alias("kept"))
    at = (F.pmod(F.xxhash64("word"), F.length("word") - 3) + 2).cast("int")
    plain = known.filter(F.col("word").rlike(r"^\p{L}+$")).select(F.substr("word", F.lit(1), at).alias("left"), F.substr("word", at + 1, F.lit(100)).alias("right"), F.lit(0).alias("kept"))
    features = ["h_joined", "h_kept", "h_left", "h_right"]
    judged = _fitted(counted(broken.distinct()), features, F.col("kept") == 1, "p_kept", LogisticRegression(regParam=0.001), "left", fit_on=counted(hyphened.unionByName(plain)))
    stays = (F.col("p_kept") >= 0.5) & (F.col("h_kept") > 0)
    return judged.select("left", "right", F.when(stays, F.concat_ws("-", "left", "right")).otherwise(F.concat("left", "right")).alias("whole"))


# ------------------------------------------------------------------- results


def analyse(df: DataFrame) -> dict[str, DataFrame]:
    """Roles of items, paragraphs with their continuation, their words, whole broken words and corrections."""
    roles, running = classified(df)
    roles = checkpointed(roles)
    paragraphs = followed(roles)
    broken_end = F.col("md").rlike(r"\p{L}[-¬‐­]\s*$")
    heads = paragraphs.filter(F.col("goes_on") & broken_end & F.col("next_md").rlike(r"^\p{Ll}")).select(F.col("next_id").alias("id"), F.lit(True).alias("skip_first"))
    inside = inside_lines(paragraphs, roles, running)
    paragraphs = checkpointed(paragraphs.join(heads, "id", "left").fillna({"skip_first": False}).join(inside, "id", "left"))
    words = checkpointed(page_words(paragraphs))
    # the letters that stand for digits differ by case, so a year keeps its own
    seen = F.when(F.col("word").rlike(YEAR_LIKE), F.col("word")).otherwise(F.lower("word"))
    said = words.filter(F.col("mark") == "").select("id", "word", seen.alias("seen"))
    vocabulary = checkpointed(said.groupBy(F.col("seen").alias("word")).agg(F.count("*").alias("n")))
    torn = words.filter(F.col("mark") != "").select("id", F.lower("left").alias("left"), F.lower("right").alias("right"))
    whole = checkpointed(torn.join(whole_words(torn.select("left", "right"), vocabulary), ["left", "right"]))
    joined = whole.select(F.col("whole").alias("word")).distinct().join(vocabulary, "word", "left_anti").withColumn("n", F.lit(1).cast("bigint"))
    fixes = corrections(vocabulary.unionByName(joined))
    return {"roles": roles, "paragraphs": paragraphs, "words": words, "said": said, "whole": whole, "fixes": checkpointed(fixes), "vocabulary": vocabulary}


def found(df: DataFrame) -> DataFrame:
    """Every case of noise (item_id, kind, word): furniture, inside, continued, hyphen, misread."""
    parts = analyse(df)
    none = F.lit("").alias("word")
    furniture = parts["roles"].filter(F.col("role") == "furniture").select("id", F.lit("furniture").alias("kind"), none)
    inside = parts["paragraphs"].filter(F.col("inside").isNotNull()).select("id", F.lit("inside").alias("kind"), none)
    continued = parts["paragraphs"].filter("goes_on").select("id", F.lit("continued").alias("kind"), none)
    fixes = parts["fixes"]
    all_words = parts["said"].select("id", "seen").unionByName(parts["whole"].select("id", F.col("whole").alias("seen")))
    misread = all_words.join(fixes, "seen").filter(F.col("meant") != F.lower("seen")).select("id", F.lit("misread").alias("kind"), F.col("meant").alias("word"))
    hyphen = parts["whole"].join(fixes.withColumnRenamed("seen", "whole"), "whole", "left").select("id", F.lit("hyphen").alias("kind"), F.coalesce("meant", "whole").alias("word"))
    every = furniture.unionByName(inside).unionByName(continued).unionByName(hyphen).unionByName(misread)
    return every.select(F.col("id").alias("item_id"), "kind", "word").distinct()


def repaired_text(texts: list[str], inside: list[list[int]], wholes: dict[str, str], fixes: dict[str, str]) -> str:
    """The items of one paragraph as one line of text: furniture and line ends gone, broken words joined, misread ones put right."""
    lines: list[str] = []
    for text, skip in zip(texts, inside, strict=True):
        lines += [x.strip() for i, x in enumerate(text.split("\n")) if i not in skip and x.strip()]
    out = lines[0] if lines else ""
    for line in lines[1:]:
        tail = re.search(rf"([^\W_][\w-]*)[{re.escape(BREAKS)}]$", out)
        head = re.match(r"[^\W\d_]+", line)
        if tail and head and head.group()[0].islower():
            left, right = tail.group(1), head.group()
            whole = wholes.get(f"{left.lower()} {right.lower()}", left.lower() + right.lower())
            kept = "-" if whole == f"{left.lower()}-{right.lower()}" else ""
            out = out[: tail.start()] + left + kept + line
        else:
            out += " " + line

    def right_word(match: re.Match) -> str:
        word = match.group()
        core = _edges.sub("", word)
        meant = fixes.get(core) or fixes.get(core.lower())
        if not meant or not core:
            return word
        shaped = meant.upper() if core.isupper() and len(core) > 1 else meant[0].upper() + meant[1:] if core[0].isupper() else meant
        return word.replace(core, shaped, 1)

    return re.sub(r"\S+", right_word, out)


def repaired(df: DataFrame) -> DataFrame:
    """The continuous paragraphs of every document: one row (doc_id, paragraph_no, first_item, text) each.

    A paragraph that goes on over pages is one row. Corrections reach a
    paragraph by a join on its own words, not as a table for everybody.
    """
    parts = analyse(df)
    rows = parts["paragraphs"]
    order = Window.partitionBy("doc_id").orderBy("item_no", "id")
    starts = F.when(F.coalesce(F.lag("goes_on").over(order), F.lit(False)), 0).otherwise(1)
    rows = rows.withColumn("start", starts).withColumn("paragraph_no", F.sum("start").over(order))
    words = parts["said"].join(parts["fixes"], "seen").select("id", "seen", "meant").distinct()
    torn = parts["whole"].select("id", F.concat_ws(" ", "left", "right").alias("seen"), F.col("whole").alias("meant")).distinct()
    joined = parts["whole"].select("id", F.col("whole").alias("seen")).join(parts["fixes"], "seen").select("id", "seen", "meant").distinct()
    pack = lambda d, name: d.groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("seen", "meant"))).alias(name))
    rows = rows.join(pack(words.unionByName(joined).distinct(), "fixes"), "id", "left").join(pack(torn, "wholes"), "id", "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    item = F.struct("item_no", "id", "md", F.coalesce("inside", F.array().cast("array<int>")).alias("inside"), F.coalesce("fixes", none).alias("fixes"), F.coalesce("wholes", none).alias("wholes"))
    first = F.min(F.struct("item_no", "id"))["id"].alias("first_item")
    chains = rows.groupBy("doc_id", "paragraph_no").agg(first, F.collect_list(item).alias("items"))

    def run(frames):
        for frame in frames:
            texts = []
            for items_ in frame["items"]:
                items_ = sorted(items_, key=lambda x: (x["item_no"] if x["item_no"] is not None else -1, x["id"]))
                merge = lambda name: {k: v for x in items_ for k, v in (x[name].items() if isinstance(x[name], dict) else x[name])}  # noqa: B023, E731
                texts.append(repaired_text([x["md"] for x in items_], [[int(i) for i in x["inside"]] for x in items_], merge("wholes"), merge("fixes")))
            yield frame[["doc_id", "paragraph_no", "first_item"]].assign(text=texts)

    return chains.select("doc_id", "paragraph_no", "first_item", "items").mapInPandas(run, "doc_id string, paragraph_no bigint, first_item string, text string")
