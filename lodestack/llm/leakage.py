"""Held-out evaluation texts inside a training corpus, found by spaced seeds.

Texts are compared as word sequences in their consistent form (see
:mod:`lodestack.llm.canonical`), in lower case; what stands between the words
doesn't count. A seed is the hash of a window of ``span`` words under a fixed
mask that ignores some positions. With ``s`` tolerated substitutions the
positions fall into ``s + 2`` interleaved groups and each mask ignores ``s`` of
them, so whatever ``s`` positions differ, one mask still agrees: no leak is
lost. Seeds of the items and of the corpus are joined, and the whole windows
are compared around each hit.

Defined results: null and blank texts, and texts of fewer than ``span`` words,
have no windows and so no rows. Repeated rows of a document or an item count
once. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.session import checkpointed

from .canonical import Words, canonical, look_alikes

SPAN = 12
#: Item seeds (8 bytes each) that go to the executors at once as a filter in front of the join; more go in blocks.
FILTER_SEEDS = 2_000_000
#: Characters that are worked on at once, so that long texts in one batch don't add up; a longer text is worked on alone.
CHARS = 4_000_000
_WORD = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """Word -> 64-bit hash, remembered while the process lives, up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _WordHashes()


def masks(span: int, substitutions: int) -> list[list[int]]:
    """The positions that each mask looks at."""
    if substitutions == 0:
        return [[p for p in range(span) if p % 3 != 1]]
    groups = substitutions + 2
    return [[p for p in range(span) if p % groups not in ignored] for ignored in combinations(range(groups), substitutions)]


def _parts(texts: list[str | None]):
    """Stretches (start, stop) of a batch with at most CHARS characters, or one text."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if held and held + size > CHARS:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def _windows(texts: list[str | None], span: int, looks: list[list[int]], wanted: np.ndarray | None, forms: Words):
    """(text number, position, seed, word hashes of the window) arrays of a batch of texts."""
    words, ends = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            words += _WORD.findall(canonical(text, forms).lower())
        ends[i] = len(words)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    count = len(h) - span + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros((0, span), np.int64)
    owner = np.searchsorted(ends, np.arange(count), side="right")
    inside = np.arange(count) + span <= ends[owner]
    if wanted is not None:
        table = np.zeros(1 << 22, bool)
        table[wanted & np.uint64((1 << 22) - 1)] = True
    at, seeds = [], []
    for m, look in enumerate(looks):
        seed = np.full(count, m + 1, np.uint64)
        for p in look:
            seed = (seed ^ h[p : p + count]) * _ODD
            seed ^= seed >> np.uint64(29)
        keep = inside
        if wanted is not None:
            keep = keep & table[seed & np.uint64((1 << 22) - 1)]
            near = np.flatnonzero(keep)
            place = np.minimum(np.searchsorted(wanted, seed[near]), len(wanted) - 1)
            near = near[wanted[place] == seed[near]]
        else:
            near = np.flatnonzero(keep)
        at.append(near)
        seeds.append(seed[near])
    at, seeds = np.concatenate(at), np.concatenate(seeds)
    window = h[at[:, None] + np.arange(span)] if len(at) else np.zeros((0, span), np.uint64)
    starts = np.concatenate([[0], ends[:-1]])
    return owner[at], at - starts[owner[at]], seeds.view(np.int64), window.view(np.int64)


def seeds(df: DataFrame, key: str, text: str, span: int, substitutions: int, wanted=None) -> DataFrame:
    """One row (key, pos, seed, win) per text, window and mask; only those with a seed in ``wanted``, if given."""
    looks = masks(span, substitutions)
    alike = look_alikes(df.sparkSession)

    def run(batches):
        only, forms = None if wanted is None else wanted.value, Words(alike)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in _parts(texts):
                owner, pos, seed, window = _windows(texts[start:stop], span, looks, only, forms)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(pos) * span + 1, span), pa.int32()), pa.array(window.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner + start)), pa.array(pos.astype(np.int32)), pa.array(seed), lists], names=["key", "pos", "seed", "win"]
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, pos int, seed bigint, win array<bigint>")


def leaked_windows(docs: DataFrame, passages: DataFrame, *, doc: str = "doc_id", text: str = "text", span: int = SPAN, substitutions: int = 0) -> DataFrame:
    """One row (doc, item, pos, item_pos, substituted) per window that a document shares with an item.

    ``passages`` has the columns ``item`` and ``passage``. Windows may differ
    in up to ``substitutions`` words. The corpus is filtered by the items'
    seeds before the join, so only hits are shuffled; more than FILTER_SEEDS
    seeds are taken in blocks, each of which reads the corpus once.
    """
    spark = docs.sparkSession
    held_out = checkpointed(seeds(passages, "item", "passage", span, substitutions))
    different = held_out.select("seed").distinct()
    blocks = max(1, -(-different.count() // FILTER_SEEDS))
    found = []
    for block in range(blocks):
        part = different.filter(F.pmod(F.xxhash64("seed"), F.lit(blocks)) == block).toPandas()["seed"].to_numpy(np.int64)
        if len(part):
            found.append(seeds(docs, doc, text, span, substitutions, spark.sparkContext.broadcast(np.sort(part.view(np.uint64)))))
    hits = reduce(DataFrame.unionByName, found) if found else seeds(docs.limit(0), doc, text, span, substitutions)
    hits = hits.select(F.col("key").alias("doc"), "pos", "seed", "win")
    items = held_out.select(F.col("key").alias("item"), F.col("pos").alias("item_pos"), "seed", F.col("win").alias("item_win"))
    differ = F.size(F.filter(F.zip_with("win", "item_win", lambda a, b: a != b), lambda x: x))
    return (
        hits.join(items, "seed")
        .withColumn("substituted", differ)
        .filter(F.col("substituted") <= substitutions)
        .select("doc", "item", "pos", "item_pos", "substituted")
    )


def passages(items: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The passages of held-out items: one row (item, passage) per item and column."""
    return items.select(F.col(key).alias("item"), F.explode(F.array(*columns)).alias("passage")).filter(F.col("passage").isNotNull()).distinct()


def leak_report(windows: DataFrame) -> DataFrame:
    """Per document and item: shared windows, those without a substitution, and the first place in the document."""
    return windows.groupBy("doc", "item").agg(
        F.count_distinct("item_pos").alias("windows"), F.count_distinct(F.when(F.col("substituted") == 0, F.col("item_pos"))).alias("exact_windows"), F.min("pos").alias("first_word")
    )
