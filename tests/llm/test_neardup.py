import re
import time
from collections import Counter

import numpy as np
import pytest

from lodestack.llm import neardup as N


def brute_trie(group, words, n, budget):
    bits = np.unpackbits(words.view(np.uint8), axis=1)
    return {(i, j) for i in range(len(n)) for j in range(i + 1, len(n)) if group[i] == group[j] and (bits[i] != bits[j]).sum() <= budget(n[i : i + 1], n[j : j + 1])[0]}


@pytest.mark.parametrize("chunk", [4, 1 << 20])
def test_trie_join_finds_exactly_what_the_budget_allows(chunk):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, (12, 4), dtype=np.uint64)
    rows = base[rng.integers(0, 12, 150)]
    for _ in range(8):
        at = rng.integers(0, 150, 60)
        rows[at, rng.integers(0, 4, 60)] ^= np.uint64(1) << rng.integers(0, 63, 60).astype(np.uint64)
    group, n = rng.integers(0, 5, 150), rng.integers(20, 60, 150)
    a, b = N.trie_self_join(group, rows.view(np.uint8), n, N.content_budget, chunk)
    got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert len(got) == len(a) and got == brute_trie(group, rows, n, N.content_budget)


@pytest.mark.parametrize("bucket, few, tile", [(4, 0, 8), (64, 0, 100), (4096, 2, 1 << 17), (4096, 512, 1 << 17)])
def test_buckets_and_roles_find_exactly_what_the_budget_allows(monkeypatch, bucket, few, tile):
    for name, value in (("BUCKET", bucket), ("FEW", few), ("TILE", tile)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 2**63, (20, 4), dtype=np.uint64)[rng.integers(0, 20, 200)]
    rows[0], rows[1] = 0, ~np.uint64(0)  # all bits differ
    for _ in range(8):
        at = rng.integers(2, 200, 80)
        rows[at, rng.integers(0, 4, 80)] ^= np.uint64(1) << rng.integers(0, 63, 80).astype(np.uint64)
    group, n, role = rng.integers(0, 3, 200), rng.integers(20, 60, 200), rng.random(200) < 0.5
    group[:2] = 0
    a, b = N.trie_self_join(group, rows.view(np.uint8), n, N.content_budget, role=role)
    got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for i, j in brute_trie(group, rows, n, N.content_budget) if role[i] or role[j]}
    assert len(got) == len(a) and got == want


def test_a_crowded_root_costs_little_more_than_comparing_its_words():
    rows = np.random.default_rng(2).integers(0, 2**64, (4000, 4), dtype=np.uint64)
    n, group = np.full(4000, 60), np.zeros(4000, np.int64)

    def seconds(work):
        took = []
        for _ in range(3):
            began = time.process_time()
            work()
            took.append(time.process_time() - began)
        return min(took)

    def compared():
        for row in rows:
            np.bitwise_count(rows ^ row).sum(axis=1)

    assert seconds(lambda: N.trie_self_join(group, rows.view(np.uint8), n, N.content_budget)) < seconds(compared)


def texts(rng, n):
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            words = out[rng.integers(len(out))][1].split()
            for _ in range(rng.integers(0, 8)):
                k = rng.integers(len(words))
                words[k : k + 1] = [[], [vocabulary[rng.integers(400)]], [words[k], words[k]]][rng.integers(3)]
            if rng.random() < 0.3:
                rng.shuffle(words)
        else:
            words = [vocabulary[int(j)] for j in rng.zipf(1.3, rng.integers(18, 90)) % 400]
        out.append((f"t{i:04}", " ".join(words)))
    return out


def brute_texts(rows):
    bags = {}
    for key, text in rows:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        if 20 <= len(words) <= 400:
            bags[key] = Counter(words)
    ids = sorted(bags)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 10 * (bags[a] & bags[b]).total() >= 8 * (bags[a] | bags[b]).total()}


def contents(spark, rows):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "id string, content string, bag string, n int")
    return {(r["id_a"], r["id_b"]) for r in N.similar_contents(df).collect()}


def test_contents_against_brute_force(spark):
    rows = texts(np.random.default_rng(1), 400)
    rows += [("n", None), ("e", ""), ("long", "word " * 100_000), rows[3], ("twin", rows[3][1].upper())]
    assert contents(spark, rows) == brute_texts(rows)


def test_hot_roots_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 3)
    rows = texts(np.random.default_rng(2), 300)
    assert contents(spark, rows) == brute_texts(rows)


def test_many_copies_are_linked_to_the_smallest(spark, monkeypatch):
    monkeypatch.setattr(N, "EXPAND", 5)
    words = [f"k{i}" for i in range(40)]
    rows = [(f"c{i:02}", " ".join(words)) for i in range(30)] + [("z1", " ".join([*words[:-1], "other"])), ("z2", " ".join(reversed(words[:-1])) + " other")]
    assert contents(spark, rows) == {("c00", f"c{i:02}") for i in range(1, 30)} | {("z1", "z2"), ("c00", "z1"), ("c00", "z2")}


def test_different_texts_of_one_bag_keep_every_pair(spark, monkeypatch):
    monkeypatch.setattr(N, "EXPAND", 5)
    monkeypatch.setattr(N, "PART", 3, raising=False)
    rng = np.random.default_rng(5)
    words = [f"k{i}" for i in range(40)]
    rows = [(f"c{i:02}", " ".join(rng.permutation(words))) for i in range(12)] + [(f"d{i}", " ".join([*rng.permutation(words[:-1]), "other"])) for i in range(7)] + [("e", " ".join([*words[:-2], "one", "two"]))]
    assert contents(spark, rows) == brute_texts(rows) and len(brute_texts(rows)) > 180

    names = [(f"n{i}", f"Report{'_-. +'[i % 5]}{'Quarterly' if i < 5 else 'quarterly'}_1.{'PDF' if i % 2 else 'docx'}") for i in range(10)] + [("o", "report-quartely-1.pdf")]
    df = spark.createDataFrame(names, "id string, filename string")
    assert {(r["id_a"], r["id_b"]) for r in N.similar_names(df).collect()} == {(a, b) for a, _ in names for b, _ in names if a < b}


def test_groups_count_every_link(spark, monkeypatch):
    monkeypatch.setattr(N, "EXPAND", 5)
    words = [f"k{i}" for i in range(40)]
    rows = [(f"c{i:02}", " ".join(words)) for i in range(9)] + [("b", " ".join([*words[:-1], "other"])), ("x", " ".join(f"x{i}" for i in range(30))), ("n", None), ("s", "short")]
    got = {r["id"]: (r["class_id"], r["links"]) for r in N.content_groups(spark.createDataFrame([*rows, rows[0]], "id string, content string")).collect()}
    assert got == {f"c{i:02}": ("b", 9) for i in range(9)} | {"b": ("b", 9), "x": ("x", 0)}
    names = spark.createDataFrame([("a", "Report_quarterly.pdf"), ("b", "report-quarterly.docx"), ("c", "something else.pdf")], "id string, filename string")
    assert {r["id"]: (r["class_id"], r["links"]) for r in N.name_groups(names).collect()} == {"a": ("a", 1), "b": ("a", 1), "c": ("c", 0)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_names_against_brute_force(spark):
    rng = np.random.default_rng(3)
    letters = list("abcdefgh가나다")
    names = []
    for i in range(250):
        if names and rng.random() < 0.6:
            s = list(names[rng.integers(len(names))])
            for _ in range(rng.integers(0, 6)):
                k = rng.integers(len(s))
                s[k : k + 1] = [[], [letters[rng.integers(11)]], [s[k], letters[rng.integers(11)]]][rng.integers(3)]
            names.append("".join(s))
        else:
            names.append("".join(letters[rng.integers(11)] for _ in range(rng.integers(10, 45))))
    rows = [(f"d{i:03}", f"{n[:4]}_{n[4:].upper()}-.v1.PDF"[: 4000]) for i, n in enumerate(names)] + [("x", None), ("y", ".pdf"), ("z", ""), ("d000", f"{names[0][:4]}_{names[0][4:].upper()}-.v1.PDF")]
    key = lambda f: re.sub(r"[\W_]", "", f.rpartition(".")[0].lower())
    known = {k: key(f) for k, f in rows if f}
    ids = sorted(k for k in known if len(known[k]) >= 12)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 100 * edits(known[a], known[b]) <= 15 * max(len(known[a]), len(known[b]))}
    df = spark.createDataFrame([(k, f, "x") for k, f in rows], "id string, filename string, name string")
    assert {(r["id_a"], r["id_b"]) for r in N.similar_names(df).collect()} == want and len(want) > 50


def test_classes_against_union_find(spark):
    rng = np.random.default_rng(4)
    pairs = [tuple(sorted((f"n{a:03}", f"n{b:03}"))) for a, b in rng.integers(0, 120, (90, 2)) if a != b] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(root(x), set()).add(x)
    want = {x: min(g) for g in groups.values() for x in g}
    got = N.classes(spark.createDataFrame(pairs, "id_a string, id_b string")).collect()
    assert {r["id"]: r["class_id"] for r in got} == want
    degree = Counter(x for p in set(pairs) for x in p)
    assert {r["id"]: r["links"] for r in got} == degree


def test_empty_tables(spark):
    assert contents(spark, []) == set()
    assert N.similar_names(spark.createDataFrame([], "id string, filename string")).count() == 0
    assert N.classes(spark.createDataFrame([], "id_a string, id_b string")).count() == 0


def test_small_texts_that_differ_as_much_as_allowed(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(400):
        words = [f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(20, 27)))]
        other = list(words)
        for at in rng.choice(len(words), (len(words) // 9), replace=False):
            other[at] = f"x{rng.integers(0, 10**6)}"
        rows += [(f"a{i:03}", " ".join(words)), (f"b{i:03}", " ".join(rng.permutation(other)))]
    got = {(r["id_a"], r["id_b"]) for r in N.similar_contents(spark.createDataFrame(rows, "id string, content string")).collect()}
    assert got == {(f"a{i:03}", f"b{i:03}") for i in range(400)}


def test_classes_that_do_not_settle_are_an_error(spark):
    chain = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(200)], "id_a string, id_b string")
    assert {r["class_id"] for r in N.classes(chain).collect()} == {"000"}
    with pytest.raises(RuntimeError):
        N.classes(chain, rounds=1)
