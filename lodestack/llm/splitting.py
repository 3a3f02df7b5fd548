"""Cutting oversized texts into overlapping pieces at natural boundaries.

A token is a word (a longest run of letters or digits) or one other character
that isn't white space. Cuts lie between tokens. A natural boundary is white
space directly after one of ``. ! ? 。 ！ ？``, or a line break. Dynamic
programming over the possible cuts minimises, in this order, the cuts that
aren't natural, the penalties of the natural ones (paragraph before line before
sentence) and the imbalance of the pieces, so that every piece stays within
``limit`` tokens and begins with the last ``overlap`` tokens before its cut.

Defined results: null texts and texts within the limit give no pieces; the
fresh parts of the pieces, in order, are exactly the text; rows that repeat an
id with the same text give the same pieces, which :func:`split_records` keeps
once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 768, 64
_TOKEN = re.compile(r"[^\W_]+|[\W_]")
_LINE = re.compile("[\n\r\x0b\x0c\x85  ]")
_PARAGRAPH = re.compile("\n[^\\S\n]*\n")
# What ends a sentence, and the costs of the kinds of cut. Any cut that isn't natural
# costs more than many natural ones, so two of them never beat one.
SENTENCE_END = frozenset(".!?。！？")
COST = {"paragraph": 0.0, "line": 0.02, "sentence": 0.05, "space": 1e5, "inside": 1e5 + 10}


def token_spans(text: str) -> np.ndarray:
    """Start and end of each token, one row per token."""
    spans = [m.span() for m in _TOKEN.finditer(text) if not m.group().isspace()]
    return np.array(spans, np.int64).reshape(-1, 2)


def _kinds(text: str, spans: np.ndarray) -> list[str]:
    """The kind of cut before each token; the first is the text's beginning."""
    kinds = ["paragraph"]
    for (_, end), (start, _) in zip(spans[:-1].tolist(), spans[1:].tolist(), strict=True):
        if start == end:
            kinds.append("inside")
            continue
        gap = text[end:start]
        if _LINE.search(gap):
            kinds.append("paragraph" if _PARAGRAPH.search(gap) else "line")
        else:
            kinds.append("sentence" if text[end - 1] in SENTENCE_END else "space")
    return kinds


def plan_cuts(kinds: list[str], limit: int, overlap: int) -> tuple[list[int], bool]:
    """Token numbers at which pieces begin afresh, and whether a stretch between natural boundaries exceeds the limit."""
    total, fresh = len(kinds), limit - overlap
    natural = np.array([i for i, kind in enumerate(kinds) if kind not in ("space", "inside")] + [total])
    gaps = np.diff(natural)
    places = [natural]
    for i in np.flatnonzero(gaps > fresh):  # only here may a cut have to be forced
        places.append(np.arange(natural[i] + 1, natural[i + 1]))
    at = np.unique(np.concatenate(places))
    price = np.array([COST[kinds[p]] if p < total else 0.0 for p in at])
    target = total / max(1, -(-(total - overlap) // fresh))
    best, back = np.full(len(at), np.inf), np.zeros(len(at), np.int64)
    best[0] = 0.0
    low = 1
    for j in range(1, len(at)):
        while low < j and at[j] - at[low] > fresh:
            low += 1
        if low < j:
            cost = best[low:j] + np.square((at[j] - at[low:j]) / target - 1.0)
            k = int(np.argmin(cost))
            best[j], back[j] = cost[k] + price[j], low + k
        if at[j] <= limit:  # the first piece repeats nothing, so it may be longer
            whole = price[j] + (at[j] / target - 1.0) ** 2
            if whole <= best[j]:
                best[j], back[j] = whole, 0
    cuts, j = [], len(at) - 1
    while j > 0:
        j = int(back[j])
        cuts.append(int(at[j]))
    return cuts[::-1], bool(gaps.max(initial=0) > limit)


def split_text(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, int, int]], bool]:
    """Pieces (start, fresh, end, tokens) in characters of an oversized text, and whether a cut has to be forced."""
    if text is None or len(text) <= limit:
        return [], False
    spans = token_spans(text)
    if len(spans) <= limit:
        return [], False
    cuts, forced = plan_cuts(_kinds(text, spans), limit, overlap)
    pieces = []
    for cut, following in zip(cuts, [*cuts[1:], len(spans)], strict=True):
        first = max(0, cut - overlap) if cut else 0
        begin, fresh = (0, 0) if cut == 0 else (int(spans[first, 0]), int(spans[cut, 0]))
        end = len(text) if following == len(spans) else int(spans[following, 0])
        pieces.append((begin, fresh, end, following - first))
    return pieces, forced


def split_records(records: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the oversized texts of ``records`` (record, record_id, text).

    One row (record, record_id, piece_no, start, fresh, end, n_tokens, cut,
    piece) per piece; ``cut`` is 'forced' or 'natural' for the record as a
    whole. A text of no more characters than ``limit`` can't be oversized, so
    most rows are dropped before they reach Python.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")

    def run(batches):
        for batch in batches:
            rows = []
            for record, record_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                pieces, forced = split_text(text, limit, overlap)
                cut = "forced" if forced else "natural"
                rows += [(record, record_id, n, a, f, b, t, cut, text[a:b]) for n, (a, f, b, t) in enumerate(pieces)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, s.type) for c, s in zip(columns, schema, strict=True)], schema=schema)

    schema = pa.schema(
        [("record", pa.string()), ("record_id", pa.string()), ("piece_no", pa.int32()), ("start", pa.int32()), ("fresh", pa.int32())]
        + [("end", pa.int32()), ("n_tokens", pa.int32()), ("cut", pa.string()), ("piece", pa.string())]
    )
    large = records.select("record", F.col("record_id").cast("string"), "text").filter(F.length("text") > limit)
    made = large.mapInArrow(run, "record string, record_id string, piece_no int, start int, fresh int, end int, n_tokens int, cut string, piece string")
    return made.dropDuplicates(["record", "record_id", "piece_no", "start", "end"])
