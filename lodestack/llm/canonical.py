"""One consistent form for texts that look the same.

The form is defined by a mapping over grapheme clusters that is worked out once
per process, checked for conflicts, and compiled into a longest-match
transducer:

* full-width, half-width and styled letters become their plain forms,
* combining accents and conjoining jamo are composed with their base: every
  sequence that composes is an entry, whatever part of it is composed already
  and in whatever order its independent accents stand,
* invisible characters (zero width, soft hyphen, direction marks) go away,
* every space separator becomes one plain space,
* letters of other scripts that look like a Latin letter become that letter.
  The published confusables come from the Unicode library that Spark brings
  along; without it a fixed list of the common ones is used.

A word that has letters of one other script which look like no Latin letter,
and no Latin letter that this script couldn't have, is a word of that script:
its letters become those of the script instead. Which words these are depends
on the unmistakable letters alone, so words that look the same stay equal, and
a Russian or Greek text keeps its letters.

Case, line breaks, tabs, digits, punctuation and real accents are kept.

Defined results: null stays null, the empty text stays empty, a text of only
invisible characters becomes empty, the form of a form is the form itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from lodestack.session import checkpointed

# Letters and the Latin letter that each looks like.
LOOKALIKES = {
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ӏ": "I", "Һ": "H",
    # Cyrillic small letters
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ѵ": "v", "ӏ": "l",
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Greek small letters
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    # Armenian
    "Օ": "O", "Տ": "S", "Լ": "L", "օ": "o", "ո": "n", "ս": "u", "հ": "h",
}
# Phonetic and small-capital letters of the Latin script itself, which look like a plain one in any word.
PHONETIC = {"ɑ": "a", "ɡ": "g", "ɩ": "i", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z"}
# Format characters that are visible, and blank characters that are not of category Cf.
VISIBLE_FORMAT = frozenset("؀؁؂؃؄؅۝܏࢐࢑࣢\U000110bd\U000110cd")
BLANK_OTHER = frozenset("͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ") | {chr(c) for c in range(0xFE00, 0xFE10)}
#: Rows of one large form that are paired under one join key; more are cut into blocks.
BLOCK = 2048
HIGHEST = 0x30000  # beyond it lie only plane-14 tags, private use and rare ideographs
LATIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


# --------------------------------------------------------------- the mapping


def _single(ch: str) -> str:
    """What one character stands for before composition."""
    if ch in BLANK_OTHER or (unicodedata.category(ch) == "Cf" and ch not in VISIBLE_FORMAT):
        return ""
    if unicodedata.category(ch) == "Zs":
        return " "
    kind = unicodedata.decomposition(ch).split(" ")[0]
    if kind in ("<wide>", "<narrow>", "<font>") or "ﬀ" <= ch <= "ﬆ":
        ch = unicodedata.normalize("NFKC", ch)
    return unicodedata.normalize("NFC", "".join(PHONETIC.get(c, c) for c in ch))


def _sequences(ch: str) -> set[str]:
    """Every sequence of more than one character that composes into ``ch``."""
    base, *marks = unicodedata.normalize("NFD", ch)
    found = set()
    for order in set(permutations(marks)) if len(marks) < 5 else ():
        for k in range(len(order)):
            start = unicodedata.normalize("NFC", base + "".join(order[:k]))
            source = start + "".join(order[k:])
            if len(start) == 1 and unicodedata.normalize("NFC", source) == ch:
                found.add(source)
    return found


class Transducer:
    """Longest-match rewriting by a trie of sources."""

    def __init__(self, entries: dict[str, str]) -> None:
        self.step: dict[tuple[int, str], int] = {}
        self.out: dict[int, str] = {}
        nodes = 1
        for source, target in entries.items():
            node = 0
            for c in source:
                node_after = self.step.get((node, c))
                if node_after is None:
                    node_after = self.step[node, c] = nodes
                    nodes += 1
                node = node_after
            self.out[node] = target
        for source, target in entries.items():  # a target that is rewritten again would need a second pass
            if self.run(target) != target:
                raise ValueError(f"conflict: {source!r} becomes {target!r}, which has a form of its own")

    def run(self, text: str) -> str:
        step, out, parts, at, end = self.step, self.out, [], 0, len(text)
        while at < end:
            node, here, best, length = 0, at, None, 1
            while here < end and (node := step.get((node, text[here]), -1)) >= 0:
                here += 1
                if node in out:
                    best, length = out[node], here - at
            parts.append(text[at] if best is None else best)
            at += length
        return "".join(parts)


def _char_class(chars: list[str]) -> str:
    """A character class with neighbouring characters joined into ranges."""
    spans: list[list[int]] = []
    for c in map(ord, sorted(chars)):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]"


class Tables:
    """The compiled mapping: single characters, compositions, decompositions, and the patterns of clusters that change."""

    def __init__(self) -> None:
        self.single: dict[str, str] = {}
        self.apart: dict[str, str] = {}
        self.scripts: dict[str, str] = {}  # letters of other scripts that have case
        compositions: dict[str, str] = {}
        extending = []
        for code in range(0x80, HIGHEST):
            if 0xD800 <= code < 0xE000:
                continue
            ch = chr(code)
            category = unicodedata.category(ch)
            to, before = _single(ch), ch
            while to != before:  # a form may itself have a form: follow it to the end
                to, before = "".join(map(_single, to)), to
            if to != ch:
                self.single[ch] = to
            if to == "" or category[0] == "M" or 0x1160 <= code <= 0x11FF:
                extending.append(ch)
            whole = unicodedata.normalize("NFD", ch)
            if len(whole) > 1 and unicodedata.normalize("NFC", ch) == ch:
                compositions.update(dict.fromkeys(_sequences(ch), ch))
                self.apart[ch] = whole
            if category in ("Lu", "Ll") and to == ch and not unicodedata.name(ch, "LATIN").startswith("LATIN"):
                self.scripts[ch] = unicodedata.name(ch).split(" ")[0]
        for source, to in self.single.items():
            if any(c in self.single for c in to):
                raise ValueError(f"conflict: {source!r} becomes {to!r}, which has a form of its own")
        self.composed = Transducer(compositions)
        self.special = frozenset(self.single).union(extending)
        self.foreign = frozenset(self.scripts)
        self.basic, self.full = (self._clusters(extending, top) for top in ("\uffff", chr(HIGHEST)))
        self.words = re.compile(f"(?:[^\\W\\d_]|{_char_class([c for c in extending if unicodedata.category(c)[0] == 'M'])})+")
        self.memo: dict[str, str] = {}

    def _clusters(self, extending: list[str], top: str) -> re.Pattern:
        more = _char_class([c for c in extending if c <= top])
        return re.compile(f".{more}+|{more}+|{_char_class([c for c in self.single if c <= top])}", re.DOTALL)

    def composition(self, text: str) -> str:
        """A cluster or word with its accents composed; accents that compose with nothing are put in their canonical order."""
        out = self.composed.run(text)
        return unicodedata.normalize("NFC", out) if any(map(unicodedata.combining, out)) else out

    def rewrite(self, match: re.Match) -> str:
        cluster = match.group()
        out = self.memo.get(cluster)
        if out is None:
            out = self.composition("".join(self.single.get(c, c) for c in cluster))
            if len(self.memo) < 200_000 and len(cluster) < 16:
                self.memo[cluster] = out
        return out


@lru_cache(maxsize=1)
def _tables() -> Tables:
    return Tables()


# -------------------------------------------------------------- look-alikes


def look_alikes(spark: SparkSession) -> dict[str, str]:
    """Letters of other scripts with case and the Latin letter that each looks like: the published confusables and the fixed list."""
    letters = sorted(_tables().foreign)
    try:
        skeleton = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join([*LATIN, *letters])).split("\n")
    except (TypeError, AttributeError):  # a session that doesn't run the library: the common ones alone
        return dict(LOOKALIKES)
    shape = dict(zip([*LATIN, *letters], skeleton, strict=True))
    same = {(shape[c], c.isupper()): c for c in reversed(LATIN)}
    published = {c: same[shape[c], c.isupper()] for c in letters if (shape[c], c.isupper()) in same}
    return published | LOOKALIKES


class Words:
    """Words in the script that their unmistakable letters belong to; see the module's text."""

    def __init__(self, looks: dict[str, str] | None = None) -> None:
        self.tables = _tables()
        self.looks = {c: to for c, to in (looks or LOOKALIKES).items() if c in self.tables.scripts}
        self.back: dict[str, dict[str, str]] = {}
        for c in sorted(self.looks, reverse=True):
            self.back.setdefault(self.tables.scripts[c], {})[self.looks[c]] = c
        self.memo: dict[str, str] = {}

    def form(self, word: str) -> str:
        tables, looks = self.tables, self.looks
        letters = "".join(tables.apart.get(c, c) for c in word)
        sure = {tables.scripts[c] for c in letters if c in tables.scripts and c not in looks}
        plain = "".join(looks.get(c, c) for c in letters)
        if len(sure) == 1:
            back = self.back.get(next(iter(sure)), {})
            if all(c in back or not c.isalpha() or (c in tables.scripts) or not unicodedata.name(c, "").startswith("LATIN") for c in plain):
                plain = "".join(back.get(c, c) for c in plain)
        return tables.composition(plain)

    def rewrite(self, match: re.Match) -> str:
        word = match.group()
        if word.isascii() or self.tables.foreign.isdisjoint(word):
            return word
        out = self.memo.get(word)
        if out is None:
            out = self.form(word)
            if len(self.memo) < 200_000 and len(word) < 64:
                self.memo[word] = out
        return out


@lru_cache(maxsize=1)
def _common() -> Words:
    return Words()


def canonical(text: str | None, words: Words | None = None) -> str | None:
    """The consistent form of one text."""
    if text is None or text.isascii():
        return text
    tables = _tables()
    present = set(text)
    if not present.isdisjoint(tables.special):
        text = (tables.basic if max(present) <= "\uffff" else tables.full).sub(tables.rewrite, text)
    if not tables.foreign.isdisjoint(text):
        text = tables.words.sub((words or _common()).rewrite, text)
    return text


# ------------------------------------------------------------------- columns


def canonical_text(column: Column | str, looks: dict[str, str] | None = None) -> Column:
    """The consistent form as a column (Arrow batches; null stays null)."""

    def forms(batches):
        words = Words(looks)
        for texts in batches:
            yield texts.map(lambda t: canonical(t, words), na_action="ignore")

    forms.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pandas_udf(forms, StringType())(column)


def text_forms(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One materialised row (key, raw, form) per row of ``df`` whose text isn't blank.

    ``raw`` and ``form`` are 128-bit fingerprints (binary) of the stored text
    and of its consistent form. Only they are kept and shuffled by later steps,
    so the texts are read once. Other columns of ``df``, whatever their names,
    are ignored.
    """
    looks = look_alikes(df.sparkSession)

    def forms(batches):
        words = Words(looks)
        for batch in batches:
            keep, raw, form = [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                if value is None:
                    continue
                one = canonical(value, words)
                if not one.strip():
                    continue
                keep.append(i)
                a = xxhash.xxh3_128_digest(value)
                raw.append(a)
                form.append(a if one == value else xxhash.xxh3_128_digest(one))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int32())), pa.array(raw, pa.binary()), pa.array(form, pa.binary())],
                names=["key", "raw", "form"],
            )

    kind = df.schema[key].dataType.simpleString()
    return checkpointed(df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(forms, f"key {kind}, raw binary, form binary"))


def form_classes(forms: DataFrame) -> DataFrame:
    """One row (key, raw, form, class_key, n) per row that shares its form with a differently stored text.

    ``class_key`` is the smallest key of the form, ``n`` the number of its
    rows. Aggregation runs before any join, so a form that holds a third of
    all rows never gathers in one task.
    """
    shared = (
        forms.groupBy("form")
        .agg(F.min("key").alias("class_key"), F.count("*").alias("n"), F.min("raw").alias("lo"), F.max("raw").alias("hi"))
        .filter(F.col("lo") != F.col("hi"))
        .select("form", "class_key", "n")
    )
    return forms.dropDuplicates(["key", "raw"]).join(shared, "form")


def _paired(rows: DataFrame) -> DataFrame:
    """Pairs (key_a, key_b) among the rows (form, raw, key, blocks) of each form; every pair of its blocks is a join key of its own."""
    cut = rows.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    a = cut.select("form", F.col("own").alias("x"), F.col("other").alias("y"), F.col("key").alias("key_a"), F.col("raw").alias("raw_a"))
    b = cut.select("form", F.col("other").alias("x"), F.col("own").alias("y"), F.col("key").alias("key_b"), F.col("raw").alias("raw_b"))
    return a.join(b, ["form", "x", "y"]).filter((F.col("key_a") < F.col("key_b")) & (F.col("raw_a") != F.col("raw_b"))).select("key_a", "key_b")


def same_form_pairs(forms: DataFrame, expand_up_to: int = 1000) -> DataFrame:
    """Pairs (key_a, key_b), smaller key first, of differently stored texts with one form.

    All pairs of different texts come out, however many variants a form has.
    Only exact copies are shortened: of a variant with more than
    ``expand_up_to`` rows the smallest key stands for it in the pairs, and each
    of its other rows has one link, to the smallest key of another variant.
    """
    rows = form_classes(forms)
    small = rows.filter(F.col("n") <= expand_up_to)
    a = small.select(F.col("form"), F.col("key").alias("key_a"), F.col("raw").alias("raw_a"))
    b = small.select(F.col("form"), F.col("key").alias("key_b"), F.col("raw").alias("raw_b"))
    all_pairs = a.join(b, "form").filter((F.col("key_a") < F.col("key_b")) & (F.col("raw_a") != F.col("raw_b"))).select("key_a", "key_b")

    large = rows.filter(F.col("n") > expand_up_to)
    variants = large.groupBy("form", "raw").agg(F.min("key").alias("lead"), F.count("*").alias("copies"))
    shown = F.when(F.col("copies") > expand_up_to, 1).otherwise(F.col("copies"))
    heads = variants.groupBy("form").agg(
        F.min(F.struct("lead", "raw")).alias("first"), F.max(F.struct("lead", "raw")).alias("last"), F.ceil(F.sum(shown) / BLOCK).alias("blocks")
    )
    members = large.join(variants, ["form", "raw"]).join(heads, "form")
    stands = (F.col("copies") <= expand_up_to) | (F.col("key") == F.col("lead"))
    star = (
        members.filter(~stands)
        .withColumn("other", F.when(F.col("raw") != F.col("first.raw"), F.col("first.lead")).otherwise(F.col("last.lead")))
        .select(F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b"))
    )
    return all_pairs.unionByName(_paired(members.filter(stands).select("form", "raw", "key", "blocks"))).unionByName(star).distinct()
