import re

import numpy as np
from pyspark.sql import functions as F

from lodestack.llm import leakage as L
from lodestack.llm.canonical import canonical


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, seed long")
    p = spark.createDataFrame([(i, q, g, "x") for i, q, g in items], "item_id string, question string, ground_truth string, item string")
    return d, L.passages(p, "item_id", ["question", "ground_truth"])


def brute(docs, items, substitutions=0, span=12):
    words = lambda t: re.findall(r"[^\W_]+", canonical(t or "").casefold())
    out = set()
    for key, *passages in items:
        for p in passages:
            w = words(p)
            for doc, text in docs:
                d = words(text)
                for i in range(len(w) - span + 1):
                    for j in range(len(d) - span + 1):
                        if sum(a != b for a, b in zip(w[i : i + span], d[j : j + span], strict=True)) <= substitutions:
                            out.add((doc, key))
    return out


def made():
    rng = np.random.default_rng(0)
    word = lambda: f"w{rng.integers(60)}"
    items = [(f"i{k}", " ".join(word() for _ in range(15)), " ".join(word() for _ in range(20))) for k in range(8)] + [("short", "too short", None), ("blank", "", " ")]
    docs = []
    for k in range(80):
        body = [word() for _ in range(60)]
        if k % 2:
            src = items[rng.integers(8)][1 + rng.integers(2)].split()
            size = rng.integers(10, len(src) + 1)
            part = src[:size]
            for _ in range(k % 3):
                part[rng.integers(len(part))] = "other"
            body[20 : 20 + len(part)] = part
        docs.append((k, ", ".join(body).upper() if k % 5 == 0 else "\n".join(body)))
    return [*docs, (900, None), (901, ""), docs[1]], items


def test_exact_leaks(spark):
    docs, items = made()
    d, p = frames(spark, docs, items)
    got = {(r["doc"], r["item"]) for r in L.leaked_windows(d, p).collect()}
    assert got == brute(docs, items) and len(got) > 10


def test_substitutions_lose_nothing(spark):
    docs, items = made()
    d, p = frames(spark, docs, items)
    for s in (1, 2):
        assert {(r["doc"], r["item"]) for r in L.leaked_windows(d, p, substitutions=s).collect()} == brute(docs, items, s)


def test_masks_cover_every_choice_of_positions():
    from itertools import combinations

    for s in (0, 1, 2, 3):
        looks = [set(m) for m in L.masks(12, s)]
        assert all(any(not look & set(bad) for look in looks) for bad in combinations(range(12), s)) or s == 0


def test_characters_do_not_matter(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, "ＯＮＥ twо thr​ee; four-five six\nseven eight nine ten eleven twelve!"), (2, text.replace("twelve", "dozen"))]
    d, p = frames(spark, docs, [("q", text, None)])
    assert [(r["doc"], r["item"]) for r in L.leaked_windows(d, p).collect()] == [(1, "q")]


def test_same_result_without_the_filter(spark, monkeypatch):
    docs, items = made()
    d, p = frames(spark, docs, items)
    monkeypatch.setattr(L, "FILTER_SEEDS", 1)
    assert {(r["doc"], r["item"]) for r in L.leaked_windows(d, p).collect()} == brute(docs, items)


def test_report_and_empty_tables(spark):
    docs, items = made()
    d, p = frames(spark, docs, items)
    report = L.leak_report(L.leaked_windows(d, p, substitutions=1))
    assert report.filter(F.col("exact_windows") > F.col("windows")).count() == 0
    assert L.leaked_windows(d.limit(0), p).count() == 0 and L.leaked_windows(d, p.limit(0)).count() == 0
