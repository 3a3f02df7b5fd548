import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack.llm import canonical as C


def test_forms():
    assert C.canonical("Ｗｉｄｅ　１２３｜") == "Wide 123|"
    assert C.canonical("Αuѕѕcһrеibung ԁеr ɡɑѕ") == "Ausschreibung der gas"
    assert C.canonical("zero​wi\xaddth‎ no\xa0break fig") == "zerowidth no break fig"
    assert C.canonical("é ö ᄒ​ᅡᆫ 각") == "é ö 한 각"
    assert C.canonical("е́") == "é"  # a look-alike below an accent


def test_visible_differences_stay():
    for text in ("Case case", "a\nb", "a\tb", "a  b", "l1I0O", "é", "“x” – …", "Пи", "🙂", "", None):
        assert C.canonical(text) == text


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("аеоА한́​　Ａ\xad")), max_size=30))
def test_a_form_is_its_own_form(text):
    once = C.canonical(text)
    assert C.canonical(once) == once
    assert unicodedata.is_normalized("NFC", once)


def test_words_of_another_script_keep_their_letters():
    for text in ("Привет, мир", "Καλημέρα κόσμε", "Ёлка и йод"):
        assert C.canonical(text) == text
    assert C.canonical("Пpивет") == "Привет"  # a Latin p in a Russian word
    assert C.canonical("приве\u0301т") == C.canonical("прив\u00e9т")
    assert C.canonical("Wordпресс а") == C.canonical("Wоrdпpесc a")
    assert C.canonical("сор") == "cop"  # nothing tells that it isn't Latin


def test_published_look_alikes(spark):
    looks = C.look_alikes(spark)
    assert looks["а"] == "a" and looks["Ꭺ"] == "A" and len(looks) > len(C.LOOKALIKES) and not any(c.isdigit() for c in looks)
    assert C.canonical("ⲤOPᎩ", C.Words(looks)) == "COPY"


def test_sequences_compose_in_any_order():
    for source in ("a\u0323\u0302", "a\u0302\u0323", "\u1ea1\u0302", "\u00e2\u0323", "\uff41\u0323\u200b\u0302"):
        assert C.canonical(source) == "\u1ead"
    assert C.canonical("x\u0323\u0302") == C.canonical("x\u0302\u0323") == unicodedata.normalize("NFC", "x\u0302\u0323")


def rows(spark, values):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in values], "doc_id long, text string, form string, raw string")


def pairs(df, **more):
    return sorted((r["key_a"], r["key_b"]) for r in C.same_form_pairs(C.text_forms(df), **more).collect())


def test_pairs_against_brute_force(spark):
    values = [(1, "abc"), (2, "аbc"), (3, "ＡBC"), (4, "ABC"), (5, "abc"), (6, None), (7, ""), (8, "​"), (9, " "), (10, "ab​c"), (2, "аbc"), (11, "x" * 200_000), (12, "х" + "x" * 199_999)]
    form = {i: (t, C.canonical(t)) for i, t in values if t}
    want = sorted((a, b) for a in form for b in form if a < b and form[a][1] == form[b][1] and form[a][0] != form[b][0] and form[a][1].strip())
    assert pairs(rows(spark, values)) == want


def test_a_large_form_stays_connected(spark):
    values = [(i, "same") for i in range(40)] + [(100 + i, "sаme") for i in range(40)] + [(200, "ｓame")]
    found = pairs(rows(spark, values), expand_up_to=10)
    parent = {}
    root = lambda x: x if parent.get(x, x) == x else root(parent[x])
    for a, b in found:
        parent[root(a)] = root(b)
    assert len({root(i) for i, _ in values}) == 1 and len(found) <= len(values)
    assert C.form_classes(C.text_forms(rows(spark, values))).filter("class_key = 0 and n = 81").count() == 81


def test_a_large_form_keeps_every_pair_of_different_texts(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 4, raising=False)
    variants = ["same", "sаme", "ｓame", "s\xadame", "ｓаme", "sаmе", "samе", "same​"]
    values = [(i, "same") for i in range(30)] + [(100 + 10 * v + i, t) for v, t in enumerate(variants[1:]) for i in range(3)]
    form = dict(values)
    different = [i for i in sorted(form) if i == 0 or i >= 100]  # 30 copies of one text stand behind the smallest
    want = {(a, b) for a in different for b in different if a < b and form[a] != form[b]}
    found = set(pairs(rows(spark, values), expand_up_to=10))
    assert len({C.canonical(t) for t in variants}) == 1 and found >= want
    assert all(form[a] != form[b] for a, b in found) and {x for p in found for x in p} == set(form) and len(found) == len(want) + 29


def test_empty_table(spark):
    assert pairs(rows(spark, [])) == []
