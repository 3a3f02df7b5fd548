"""Encoding a corpus with a public byte-level BPE vocabulary.

The merge loop keeps one bucket of linked-list positions per merge rank and a
two-level bitmap of the ranks that have a bucket; find-first-set on the bitmap
gives the next rank, and entries that an earlier merge has made stale are
skipped. Its cost hardly depends on a pre-token's length, so a very long run of
letters costs no more per byte than a short word.

A text is cut at single spaces first, because no pre-token reaches across one;
what lies between is encoded once per Python worker and remembered, up to a
bound. Texts with runs of spaces take the full pre-token pattern.

Defined results: null and empty texts have the empty list; special tokens are
ordinary text; every other text decodes back to its UTF-8 bytes.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary lies, unless the caller names another file of the same format.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's published pre-token pattern.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBER = 400_000


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes -> rank, from lines of base64 and number."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Encoder:
    """The vocabulary and what one process remembers of its work."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.pattern = regex.compile(PRE_TOKEN)
        self.leaves = [0] * ((max(ranks.values(), default=0) >> 8) + 1)
        self.bits = [1 << k for k in range(max(256, len(self.leaves)))]  # so that the bitmap's words needn't be shifted anew
        encode = self._chunk

        class Memory(dict):
            def __init__(self, prefix: str) -> None:
                self.prefix = prefix

            def __missing__(self, piece: str) -> bytes:
                if len(self) >= REMEMBER:
                    self.clear()
                ids = encode(self.prefix + piece)
                if len(piece) <= 64:
                    self[piece] = ids
                return ids

        class Tokens(dict):
            def __missing__(tokens, token: str) -> bytes:  # noqa: N805
                if len(tokens) >= REMEMBER:
                    tokens.clear()
                data = token.encode("utf-8", "surrogatepass")
                whole = ranks.get(data)
                ids = np.array([whole] if whole is not None else self.merge(data), "<i4").tobytes()
                if len(token) <= 64:
                    tokens[token] = ids
                return ids

        self.plain, self.spaced, self.tokens = Memory(""), Memory(" "), Tokens()

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token.

        ``leaves`` has 256 ranks per word and ``top`` a bit per word that isn't
        zero, however many there are; all are zero again at the end. The loop is written out because
        calls would take most of its time.
        """
        get, leaves, bit = self.ranks.get, self.leaves, self.bits
        n = len(data)
        parts: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets: dict[int, list[int]] = {}
        top = 0
        for i in range(n - 1):
            rank = get(data[i : i + 2])
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    leaves[rank >> 8] |= bit[rank & 255]
                    top |= bit[rank >> 8]
        while top:
            high = (top & -top).bit_length() - 1
            leaf = leaves[high]
            low = leaf & -leaf
            leaves[high] = leaf = leaf ^ low
            if not leaf:
                top ^= bit[high]
            rank = (high << 8) + low.bit_length() - 1
            positions = buckets.pop(rank)
            if len(positions) > 1:
                positions.sort()  # equal ranks merge from left to right
            for i in positions:
                left = parts[i]
                if left is None or (j := after[i]) >= n:
                    continue
                joined = left + parts[j]
                if get(joined) != rank:  # stale: a neighbour has changed since
                    continue
                parts[i], parts[j] = joined, None
                k = after[i] = after[j]
                h = before[i]
                if k < n:
                    before[k] = i
                    new = get(joined + parts[k])
                    if new is not None:
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            buckets[new] = [i]
                            leaves[new >> 8] |= bit[new & 255]
                            top |= bit[new >> 8]
                if h >= 0:
                    new = get(parts[h] + joined)
                    if new is not None:
                        if new in buckets:
                            buckets[new].append(h)
                        else:
                            buckets[new] = [h]
                            leaves[new >> 8] |= bit[new & 255]
                            top |= bit[new >> 8]
        ranks = self.ranks
        return [ranks[p] for p in parts if p is not None]

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.tokens.__getitem__, self.pattern.findall(chunk)))

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if "  " in text:
            return self._chunk(text)
        first, *rest = text.split(" ")
        head = self.plain[first] if first else b""
        return head + b"".join(map(self.spaced.__getitem__, rest))


_encoders: dict[int, Encoder] = {}


def _encoder(data: bytes) -> Encoder:
    key = hash(data)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(parse_ranks(data))
    return _encoders[key]


def read_vocabulary(spark: SparkSession, path: str = VOCABULARY):
    """The vocabulary file as a broadcast value; its size is that of one public vocabulary, under 16 MB."""
    with open(path, "rb") as file:
        data = file.read(16 * 2**20 + 1)
    if len(data) > 16 * 2**20:
        raise ValueError(f"{path} is larger than a vocabulary")
    return spark.sparkContext.broadcast(data)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """One row (key, ids) per row of ``df``; the name of ``key`` is kept. Narrow: nothing is shuffled."""
    vocabulary = read_vocabulary(df.sparkSession, path)

    def run(batches):
        encoder = _encoder(vocabulary.value)
        for batch in batches:
            coded = [encoder.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(coded) + 1, np.int32)
            np.cumsum([len(c) >> 2 for c in coded], out=offsets[1:])
            values = np.frombuffer(b"".join(coded), "<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
