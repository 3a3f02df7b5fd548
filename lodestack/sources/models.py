"""Seams for models: embedding and generation are functions that the caller hands in.

A model runs in Python workers on Arrow batches; it is loaded once per worker
by the factory. The built-in embedder is a deterministic stand-in that hashes
words, so that pipelines run without a model; it claims no quality.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dim: int = 64) -> Embedder:
    """Word-hash vectors of length 1."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = xxhash.xxh64_intdigest(word)
                out[i, h % dim] += 1.0 if h >> 63 else -1.0
        return out

    return embed


def embed_texts(df: DataFrame, text: str, factory: Callable[[], Embedder] = hashing_embedder, batch: int = 32) -> DataFrame:
    """``df`` with ``embedding``, normalised to length 1; null texts have none. ``batch`` texts go to the model at once."""
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(frames):
        model = factory()
        for frame in frames:
            vectors: list = [None] * len(frame)
            there = [i for i, t in enumerate(frame[text]) if isinstance(t, str)]
            for at in range(0, len(there), batch):
                rows = there[at : at + batch]
                made = model([frame[text].iloc[i] for i in rows])
                size = np.linalg.norm(made, axis=1, keepdims=True)
                for i, v in zip(rows, made / np.where(size > 0, size, 1), strict=True):
                    vectors[i] = v
            yield frame.assign(embedding=pd.Series(vectors, index=frame.index, dtype=object))

    return df.mapInPandas(run, schema)


def indexed(stored: DataFrame, limit_length: int | None = None) -> DataFrame:
    """Counts of rows that got a vector and of those that didn't (success, errors), as an index sink reports them."""
    good = F.col("embedding").isNotNull() if limit_length is None else (F.size("embedding") == limit_length)
    return stored.agg(F.count_if(F.coalesce(good, F.lit(False))).alias("success"), F.count_if(~F.coalesce(good, F.lit(False))).alias("errors"))


Scorer = Callable[[list[tuple[str, str]]], list[float]]


def coverage_scorer() -> Scorer:
    """Share of the query's distinct words that a text has: the stand-in for a cross-encoder."""
    word = regex.compile(r"[\p{L}\p{N}]+")

    def score(pairs: list[tuple[str, str]]) -> list[float]:
        asked = [set(word.findall(q.lower())) for q, _ in pairs]
        return [len(a & set(word.findall(t.lower()))) / len(a) if a else 0.0 for a, (_, t) in zip(asked, pairs, strict=True)]

    return score


def score_pairs(df: DataFrame, query: str, text: str, factory: Callable[[], Scorer] = coverage_scorer, batch: int = 16, chars: int = 4000) -> DataFrame:
    """``df`` with ``rerank_score`` of each (query, text) pair; ``batch`` pairs go to the model at once, null texts are empty ones."""
    schema = T.StructType([*df.schema.fields, T.StructField("rerank_score", T.DoubleType())])

    def run(frames):
        model = factory()
        for frame in frames:
            pairs = [(q or "", (t or "")[:chars]) for q, t in zip(frame[query], frame[text], strict=True)]
            scores = [s for at in range(0, len(pairs), batch) for s in model(pairs[at : at + batch])]
            yield frame.assign(rerank_score=pd.Series(scores, index=frame.index, dtype="float64"))

    return df.mapInPandas(run, schema)
