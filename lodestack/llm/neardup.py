"""Near-duplicate records by a self-join of binary tries.

A record is a bag of features (word occurrences, or grams of a name). Its
signature has one parity bit per hash bucket of features, so two signatures
differ in at most as many bits as the bags differ in features: a Hamming error
budget that follows from the similarity threshold never loses a pair.

One trie over all records would have to keep every pair of upper nodes alive,
because a large budget prunes only after many bits. The features are therefore
dealt into more parts than the budget has errors (for names: into segments,
one more than edits allowed), so that a similar pair agrees entirely in one
part. Each part's value is the root of a trie; the shuffle brings the records
of a root together, and there node pairs are traversed together, eight bits a
level, with their differing bits added up and pruned as soon as they exceed the
budget. Subtrees of at most BUCKET signatures aren't branched further, as large
budgets prune hardly anything there: their signatures are compared a word at a
time, in tiles. What is left is verified exactly.

Roots that many records share are cut into blocks, and each pair of blocks is
its own task, so no group outgrows a task. The records of one bag are one record
for the join and are expanded into all their pairs afterwards, in parts where a
bag has many. Only exact copies, equal byte by byte, are shortened: of more than
EXPAND copies every member is linked to the smallest id, which stands for them
in pairs with other texts.

Defined results: nulls, and texts or names outside the size limits, have no
rows; repeated rows count once; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

from lodestack.session import checkpointed

#: Exact copies of one stored text or name that are expanded into all pairs.
EXPAND = 64
#: Ids in one part of a bag that many records share.
PART = 256
#: Records of one root that a task compares; more are cut into blocks.
BLOCK = 16_384
#: Signatures of two subtrees that are compared without branching: of more pairs than FEW, and up to BUCKET on either side.
BUCKET, FEW = 4096, 512
#: Pairs in a tile of such a comparison.
TILE = 1 << 17
LEAST_WORDS, MOST_WORDS = 20, 400
LEAST_NAME = 12
BITS = 256
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RECORD = "id string, bag binary, raw binary, n int, sig binary, own array<bigint>, low array<bigint>"


# ---------------------------------------------------------------- signatures


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _WordHashes()


def size_classes() -> np.ndarray:
    """First size of each size class; sizes of similar bags (at least 80 % shared) are in one class or in neighbouring ones."""
    sizes, at = [], float(LEAST_WORDS)
    while at <= MOST_WORDS * 1.25:
        sizes.append(int(np.ceil(at - 1e-9)))
        at *= 1.25
    return np.array(sizes)


_CLASSES = size_classes()
#: Largest size of each class.
_LARGEST = np.array([int(b) - 1 for b in [*_CLASSES[1:], 10**6]])
#: Parts of a class: more than two bags up to the class's largest size may differ in at a similarity of 0.8, and some to spare for empty parts.
_PARTS = np.array([p + 2 + p // 16 for p in (2 * _LARGEST // 9 + 1).tolist()])


def _parity(owner: np.ndarray, features: np.ndarray, count: int) -> np.ndarray:
    """Parity bits of each owner's features, one row of bytes per owner."""
    ones = np.bincount(owner * BITS + (features & np.uint64(BITS - 1)).astype(np.int64), minlength=count * BITS) & 1
    return np.packbits(ones.reshape(count, BITS).astype(np.uint8), axis=1)


def _dealt(owner: np.ndarray, features: np.ndarray, offsets: np.ndarray, parts: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Value of every part of every owner, and whether it has a feature; ``shift`` chooses the hash bits that deal."""
    place = offsets[owner] + ((features >> np.uint64(shift)) % parts[owner].astype(np.uint64)).astype(np.int64)
    value = np.zeros(offsets[-1], np.uint64)
    np.add.at(value, place, _mixed(features))
    return value, np.bincount(place, minlength=offsets[-1]) > 0


def _part_keys(owner: np.ndarray, features: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Root keys of every owner, whose size class is ``group``, and offsets per owner.

    A part without features is no root by itself, as very many records would
    share it. Two records can agree in such parts alone only if all the other
    parts differ, so only records with too few other parts need more: for each
    of their empty parts the parts of a second dealing, one of which must agree.
    """
    count, parts = len(size), _PARTS[group]
    offsets = np.concatenate([[0], np.cumsum(parts)])
    value, filled = _dealt(owner, features, offsets, parts, 8)
    of = np.repeat(np.arange(count), parts)
    number = np.arange(offsets[-1]) - offsets[of]
    label = _mixed(np.repeat(group, parts).astype(np.uint64) * np.uint64(4096) + number.astype(np.uint64))
    others = np.bincount(of, weights=filled, minlength=count)
    most_differ = (size + np.minimum(size * 5 // 4, _LARGEST[group])) // 9
    empty = np.flatnonzero(~filled & (others <= most_differ)[of])
    keys, owners = [_mixed(value ^ label)[filled]], [of[filled]]
    if len(empty):
        second, _ = _dealt(owner, features, offsets, parts, 36)
        each = parts[of[empty]]
        nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        spot = np.repeat(empty, each)
        keys.append(_mixed(second[offsets[of[spot]] + nth] ^ _mixed(label[spot] + nth.astype(np.uint64) + np.uint64(1))))
        owners.append(of[spot])
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return keys[order].view(np.int64), np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=count))])


def _list_array(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def content_records(df: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """Records of the texts with LEAST_WORDS to MOST_WORDS words: bag, size, signature and root keys.

    ``own`` are the roots of the record's size class, ``low`` those of the next
    class, in which it may be the smaller partner.
    """

    def run(batches):
        for batch in batches:
            words, sizes, rows, raw = [], [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                if value is not None and len(value) >= 2 * LEAST_WORDS - 1:
                    found = _WORD.findall(value.lower())
                    if LEAST_WORDS <= len(found) <= MOST_WORDS:
                        rows.append(i)
                        raw.append(xxhash.xxh3_128_digest(value))
                        sizes.append(len(found))
                        words += found
            n = np.array(sizes, np.int64)
            owner = np.repeat(np.arange(len(n)), n)
            h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
            order = np.lexsort((h, owner))
            h, owner = h[order], owner[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, bool)
            begin = np.flatnonzero(new)
            times = np.arange(len(h)) - np.repeat(begin, np.diff([*begin, len(h)])) if len(h) else np.zeros(0, np.int64)
            feature = _mixed(h + times.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            ends = np.concatenate([[0], np.cumsum(n)])
            data = h.tobytes()
            bags = [xxhash.xxh3_128_digest(data[8 * a : 8 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            group = np.searchsorted(_CLASSES, n, side="right") - 1
            own, low = (_list_array(*_part_keys(owner, feature, n, group + step)) for step in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(bags, pa.binary()), pa.array(raw, pa.binary()), pa.array(n.astype(np.int32))]
                + [pa.array([s.tobytes() for s in _parity(owner, feature, len(n))], pa.binary()), own, low],
                names=["id", "bag", "raw", "n", "sig", "own", "low"],
            )

    source = df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull())
    return source.mapInArrow(run, _RECORD)


def name_key(column: Column | str) -> Column:
    """A file name up to its last dot, in lower case, letters and digits only."""
    column = F.col(column) if isinstance(column, str) else column
    return F.lower(F.regexp_replace(F.regexp_replace(column, r"(?s)\.[^.]*$", ""), r"[^\p{L}\p{N}]", ""))


def _segments(length: int) -> list[tuple[int, int]]:
    """Start and size of the segments of a name that is the shorter of a pair: one more than the edits that such a pair may have."""
    edits = 15 * (100 * length // 85) // 100
    short, extra = divmod(length, edits + 1)
    spans, at = [], 0
    for i in range(edits + 1):
        size = short + (i >= edits + 1 - extra)
        spans.append((at, size))
        at += size
    return spans


def _roots(name: str) -> tuple[list[int], list[int]]:
    """Root keys of a name as the shorter partner, and as the longer or equal one."""
    b = len(name)
    digest = xxhash.xxh64_intdigest
    own = [digest(f"{b} {i} {name[p : p + s]}") for i, (p, s) in enumerate(_segments(b))]
    low = []
    for a in range(max(LEAST_NAME, -(-85 * b // 100)), b + 1):
        spans, shift = _segments(a), b - a
        edits = len(spans) - 1
        for i, (p, s) in enumerate(spans):
            first = max(0, p - i, p + shift - (edits - i))
            last = min(b - s, p + i, p + shift + (edits - i))
            low += [digest(f"{a} {i} {name[q : q + s]}") for q in range(first, last + 1)]
    return own, low


def name_records(df: DataFrame, key: str = "id", name: str = "filename") -> DataFrame:
    """Records of the names with at least LEAST_NAME letters and digits; ``bag`` is the name itself, in UTF-8."""

    def run(batches):
        for batch in batches:
            names = batch.column(1).to_pylist()
            own, low, sig = [], [], []
            for value in names:
                a, b = _roots(value)
                own.append(np.array(a, np.uint64).view(np.int64))
                low.append(np.array(sorted(set(b)), np.uint64).view(np.int64))
                code = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                grams = np.concatenate([_mixed(code) % np.uint64(64), np.uint64(64) + _mixed(code[:-1] << np.uint64(32) | code[1:]) % np.uint64(BITS - 64)])
                sig.append(_parity(np.zeros(len(grams), np.int64), grams, 1)[0].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([v.encode("utf-8", "surrogatepass") for v in names], pa.binary()), batch.column(2), pa.array([len(v) for v in names], pa.int32())]
                + [pa.array(sig, pa.binary()), pa.array(own, pa.list_(pa.int64())), pa.array(low, pa.list_(pa.int64()))],
                names=["id", "bag", "raw", "n", "sig", "own", "low"],
            )

    source = df.select(F.col(key).cast("string").alias("id"), name_key(name).alias("name"), F.unhex(F.md5(F.col(name).cast("string"))).alias("raw")).filter(F.col("id").isNotNull() & (F.length("name") >= LEAST_NAME))
    return source.distinct().mapInArrow(run, _RECORD)


# ---------------------------------------------------------------- the trie join


def content_budget(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Bits in which the signatures of bags of these sizes may differ at a similarity of 0.8."""
    return (n_a + n_b) // 9


def name_budget(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Bits for names of these lengths: an edit changes at most 2 of the characters and 4 of the bigrams."""
    return 6 * (15 * np.maximum(n_a, n_b) // 100)


def _bucket_pairs(words: list[np.ndarray], n: np.ndarray, budget, x: tuple[int, int], y: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a signature from the range ``x`` and one from ``y`` that differ in no more bits than ``budget`` allows, and these bits.

    ``words`` are the signatures' words and ``n`` the largest sizes. The bits of
    a tile's pairs are added up word by word until few pairs are left.
    """
    most = min(int(budget(n[x[0] : x[1]].max(), n[y[0] : y[1]].max())), 255)
    found = [(np.zeros(0, np.int64),) * 3]
    step = max(1, TILE // (y[1] - y[0]))
    for top in range(x[0], x[1], step):
        end, left = min(top + step, x[1]), top if x == y else y[0]
        wide = y[1] - left
        at, total = 0, None
        while at < len(words) - 1:  # the last word is left, so that a byte holds the sum
            bits = np.bitwise_count(words[at][top:end, None] ^ words[at][None, left : y[1]])
            total = bits if total is None else np.add(total, bits, out=total)
            close, at = total <= most, at + 1
            if np.count_nonzero(close) * 50 <= total.size:
                break
        near = np.flatnonzero(close)
        a, b = top + near // wide, left + near % wide
        differ = total.ravel()[near].astype(np.int64)
        for word in words[at:]:
            differ += np.bitwise_count(word[a] ^ word[b])
        keep = (differ <= budget(n[a], n[b])) & ((a <= b) | (x != y))
        found.append((a[keep], b[keep], differ[keep]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def trie_self_join(group: np.ndarray, signature: np.ndarray, n: np.ndarray, budget, chunk: int = 1 << 20, role: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of one group whose signatures differ in no more bits than ``budget`` allows.

    ``group`` is the root of each row, ``signature`` its bits in bytes; of two
    rows at least one must have the ``role``, if it is given. A node
    is a run of sorted rows with equal leading bytes, so a level of the trie is
    eight bits. A pair of nodes goes down together; the bits in which the two
    differ add up, and ``budget`` of the largest sizes below them prunes the
    pair. Paths without a fork are compressed: of two nodes with one signature
    each the rest is compared at once, as it is of two nodes that hold many
    pairs of signatures, but at most BUCKET signatures each.
    """
    levels = signature.shape[1]
    words = signature.view(">u8").astype(np.uint64)
    other = np.zeros(len(group), bool) if role is None else ~role
    order = np.lexsort((*words.T[::-1], other, group))
    group, other, signature, words, n = group[order], other[order], signature[order], words[order], n[order]
    rows = len(group)
    fresh = np.ones(rows + 1, bool)
    fresh[1:rows] = (group[1:] != group[:-1]) | (other[1:] != other[:-1])
    starts = [np.flatnonzero(fresh)]
    for level in range(levels):
        fresh[1:rows] |= signature[1:, level] != signature[:-1, level]
        starts.append(np.flatnonzero(fresh))
    largest = [np.maximum.reduceat(n, s[:-1]) for s in starts]
    children = [np.searchsorted(starts[level + 1], starts[level]) for level in range(levels)]
    leaf = [np.searchsorted(starts[levels], s) for s in starts]  # first signature of each node
    held = [np.diff(f) for f in leaf]
    lone = [h == 1 for h in held]
    columns = [np.ascontiguousarray(c) for c in words[starts[levels][:-1]].T]

    found_a, found_b = [], []
    first = starts[0][:-1]
    roots = np.flatnonzero((np.diff(starts[0]) > 1) & ~other[first])
    across = np.flatnonzero(group[first[1:]] == group[first[:-1]])  # the rows of a group with the role come before those without
    a, b = np.concatenate([roots, across]), np.concatenate([roots, across + 1])
    stack = [(0, a, b, np.zeros(len(a), np.int64))] if len(a) else []
    while stack:
        level, a, b, bits = stack.pop()
        if level < levels:
            both = lone[level][a] & lone[level][b]
            if both.any():
                x, y = starts[level][a[both]], starts[level][b[both]]
                differ = np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int64)
                near = differ <= budget(largest[level][a[both]], largest[level][b[both]])
                if near.any():
                    stack.append((levels, leaf[level][a[both]][near], leaf[level][b[both]][near], differ[near]))
                a, b, bits = a[~both], b[~both], bits[~both]
            full = (held[level][a] * held[level][b] > FEW) & (np.maximum(held[level][a], held[level][b]) <= BUCKET)
            for x, y in zip(a[full].tolist(), b[full].tolist(), strict=True):
                near = _bucket_pairs(columns, largest[levels], budget, *((int(leaf[level][v]), int(leaf[level][v + 1])) for v in (x, y)))
                if len(near[0]):
                    stack.append((levels, *near))
            a, b, bits = a[~full], b[~full], bits[~full]
            if not len(a):
                continue
            low_a, low_b = children[level][a], children[level][b]
            wide_a, wide_b = children[level][a + 1] - low_a, children[level][b + 1] - low_b
        else:
            low_a, low_b, wide_a, wide_b = starts[level][a], starts[level][b], np.diff(starts[level])[a], np.diff(starts[level])[b]
        product = wide_a * wide_b
        total = np.cumsum(product)
        if len(a) > 1 and total[-1] > chunk:  # depth first in slices, so that memory stays bounded
            half = max(1, min(len(a) - 1, int(np.searchsorted(total, total[-1] // 2))))
            stack += [(level, a[:half], b[:half], bits[:half]), (level, a[half:], b[half:], bits[half:])]
            continue
        pair = np.repeat(np.arange(len(a)), product)
        within = np.arange(len(pair)) - np.repeat(total - product, product)
        x, y = low_a[pair] + within // wide_b[pair], low_b[pair] + within % wide_b[pair]
        if level == levels:
            keep = x < y
            found_a.append(x[keep])
            found_b.append(y[keep])
            continue
        keep = (a[pair] != b[pair]) | (x <= y)
        x, y, pair = x[keep], y[keep], pair[keep]
        byte = signature[starts[level + 1][:-1], level]
        bits = bits[pair] + np.bitwise_count(byte[x] ^ byte[y])
        keep = bits <= budget(largest[level + 1][x], largest[level + 1][y])
        if keep.any():
            stack.append((level + 1, x[keep], y[keep], bits[keep]))
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order[np.concatenate(found_a)], order[np.concatenate(found_b)]


def _join_roots(budget):
    """Join of the sorted rows (root, sub, blk, role, rid, n, sig) of a partition; a root may go on in the next batch.

    A key of 64 bits stands for a root; should two roots share one, their rows
    meet without need and the budget decides.
    """

    def join(table: pa.Table) -> pa.RecordBatch:
        root, sub = table.column("root").to_numpy(), table.column("sub").to_numpy()
        change = np.concatenate([[True], (root[1:] != root[:-1]) | (sub[1:] != sub[:-1])])
        group = np.cumsum(change) - 1
        alone = np.bincount(group)[group] < 2
        table, group = table.filter(pa.array(~alone)), group[~alone]
        if not len(group):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["a", "b"])
        rid, blk, sub = (table.column(c).to_numpy() for c in ("rid", "blk", "sub"))
        role = table.column("role").to_numpy(zero_copy_only=False).astype(bool)
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(group), -1)
        a, b = trie_self_join(group, sig, table.column("n").to_numpy().astype(np.int64), budget, role=role)
        apart = (sub[a] < 0) | (blk[a] != blk[b])  # rows of a block meet in the block's own task
        keep = apart & (rid[a] != rid[b])
        x, y = np.minimum(rid[a], rid[b])[keep], np.maximum(rid[a], rid[b])[keep]
        pairs = np.unique(np.stack([x, y], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            root, sub = table.column("root").to_numpy(), table.column("sub").to_numpy()
            last = np.flatnonzero((root != root[-1]) | (sub != sub[-1]))
            first = int(last[-1]) + 1 if len(last) else 0
            if first:
                yield join(table.slice(0, first).combine_chunks())
            rest = table.slice(first)
        if rest is not None and rest.num_rows:
            yield join(rest.combine_chunks())

    return run


def candidate_pairs(records: DataFrame, budget) -> DataFrame:
    """Pairs (a, b) of the ids ``rid`` of ``records`` (rid, n, sig, own, low) that a trie join keeps."""

    def rows(source: DataFrame) -> DataFrame:
        own = source.select(F.explode("own").alias("root"), F.lit(True).alias("role"), "rid", "n", "sig")
        low = source.select(F.explode("low").alias("root"), F.lit(False).alias("role"), "rid", "n", "sig")
        return own.unionByName(low)

    # Which roots are shared by very many records only decides how work is cut, so a hash sample of the records is enough to tell.
    sampled = 64
    sample = rows(records.filter(F.pmod(F.xxhash64("rid"), F.lit(sampled)) == 0)).groupBy("root").count()
    shared = sample.filter(F.col("count") * sampled > BLOCK).select("root", F.ceil(F.col("count") * sampled / BLOCK).cast("int").alias("blocks"))
    most = 100_000
    known = shared.limit(most + 1).toArrow()
    every = rows(records)
    if known.num_rows == 0:
        cut = every.select("root", F.lit(-1).cast("bigint").alias("sub"), F.lit(0).cast("bigint").alias("blk"), "role", "rid", "n", "sig")
    else:
        table = records.sparkSession.createDataFrame(known.to_pandas(), "root bigint, blocks int")
        marked = every.join(F.broadcast(table) if known.num_rows <= most else shared, "root", "left")
        blk = F.pmod(F.xxhash64("rid"), F.col("blocks"))
        marked = marked.withColumn("blk", F.coalesce(blk, F.lit(0).cast("bigint")))
        others = F.coalesce(F.sequence(F.lit(0), F.col("blocks") - 1), F.array(F.lit(-1)))
        marked = marked.withColumn("other", F.explode(others.cast("array<bigint>")))
        sub = F.when(F.col("other") < 0, -1).when(F.col("other") == F.col("blk"), -2 - F.col("blk")).otherwise(F.least("blk", "other") * 65536 + F.greatest("blk", "other"))
        cut = marked.select("root", sub.alias("sub"), "blk", "role", "rid", "n", "sig")
    return cut.repartition("root", "sub").sortWithinPartitions("root", "sub").mapInArrow(_join_roots(budget), "a bigint, b bigint").distinct()


# ---------------------------------------------------------------- whole operators


def distinct_bags(records: DataFrame) -> DataFrame:
    """One materialised row (rid, ids, bag, n, sig, own, low) per different bag, with its EXPAND + 1 smallest ids.

    The rank limit also runs before the shuffle, so no task holds all records
    of a bag; what lies beyond it is found again by :func:`_members`.
    """
    order = Window.partitionBy("bag").orderBy("id")
    few = records.withColumn("nth", F.dense_rank().over(order)).filter(F.col("nth") <= EXPAND + 1)
    one = few.groupBy("bag").agg(F.array_sort(F.collect_set("id")).alias("ids"), *(F.first(c).alias(c) for c in ("n", "sig", "own", "low")))
    return checkpointed(one.withColumn("rid", F.monotonically_increasing_id()))


def _members(bags: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the bags with more than EXPAND ids: the ids that stand in pairs, as parts (rid, part, ids), and the links (id_a, id_b) of exact copies.

    Every id stands for itself but those of a text with more than EXPAND exact
    copies, for which the smallest id stands.
    """
    many = bags.filter(F.size("ids") > EXPAND).select("bag", "rid")
    rows = checkpointed(records.select("id", "bag", "raw").join(many, "bag").select("rid", "raw", "id").distinct())
    texts = rows.groupBy("rid", "raw").agg(F.min("id").alias("lead"), F.count("*").alias("copies"))
    rows = rows.join(texts, ["rid", "raw"])
    stands = (F.col("copies") <= EXPAND) | (F.col("id") == F.col("lead"))
    links = rows.filter(~stands).select(F.col("lead").alias("id_a"), F.col("id").alias("id_b"))
    shown = rows.filter(stands).select("rid", "id").distinct()
    parts = shown.groupBy("rid").agg(F.ceil(F.count("*") / PART).alias("parts"))
    cut = shown.join(parts, "rid").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    return checkpointed(cut.groupBy("rid", "part").agg(F.collect_list("id").alias("ids"))), links


def _crossed(pairs: DataFrame) -> DataFrame:
    """Pairs of lists (ids_a, ids_b) as pairs of ids, smaller first."""
    both = pairs.select(F.explode("ids_a").alias("a"), "ids_b").select("a", F.explode("ids_b").alias("b")).filter(F.col("a") != F.col("b"))
    return both.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def _id_pairs(near: DataFrame, bags: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs of ids from the pairs of similar bags ``near`` (a, b, ids_a, ids_b) and from within each bag."""
    few = bags.filter(F.size("ids").between(2, EXPAND))
    within = _crossed(few.select(F.col("ids").alias("ids_a"), F.col("ids").alias("ids_b")))
    if bags.filter(F.size("ids") > EXPAND).isEmpty():
        return _crossed(near).unionByName(within).distinct()
    near = checkpointed(near)
    plain = (F.size("ids_a") <= EXPAND) & (F.size("ids_b") <= EXPAND)
    parts, links = _members(bags, records)
    every = bags.filter(F.size("ids") <= EXPAND).select("rid", F.lit(0).cast("bigint").alias("part"), "ids").unionByName(parts)
    a, b = every.toDF("a", "part_a", "ids_a"), every.toDF("b", "part_b", "ids_b")
    across = near.filter(~plain).select("a", "b").join(a, "a").join(b, "b")
    inside = parts.toDF("a", "part_a", "ids_a").join(parts.toDF("b", "part_b", "ids_b"), (F.col("a") == F.col("b")) & (F.col("part_a") <= F.col("part_b")))
    blocks = across.unionByName(inside.select(across.columns)).repartition("a", "part_a", "b", "part_b")
    return _crossed(near.filter(plain)).unionByName(within).unionByName(_crossed(blocks)).unionByName(links).distinct()


@pandas_udf(IntegerType())
def _shared_words(a: pd.Series, b: pd.Series) -> pd.Series:
    """Shared words of two texts per 10,000 of all their words, rounded down."""
    out = []
    for x, y in zip(a, b, strict=True):
        counts: dict[str, int] = {}
        left, right = _WORD.findall(x.lower()), _WORD.findall(y.lower())
        for w in left:
            counts[w] = counts.get(w, 0) + 1
        shared = 0
        for w in right:
            if counts.get(w, 0) > 0:
                counts[w] -= 1
                shared += 1
        out.append(shared * 10_000 // (len(left) + len(right) - shared))
    return pd.Series(out, dtype="int32")


def _near_contents(df: DataFrame, bags: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (a, b, ids_a, ids_b) of bags whose shared words are at least 80 % of all their words."""
    found = candidate_pairs(bags, content_budget)
    heads = bags.select("rid", "ids")
    near = found.join(heads.toDF("a", "ids_a"), "a").join(heads.toDF("b", "ids_b"), "b")
    texts = df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).filter(F.length(text) >= 2 * LEAST_WORDS - 1)
    return (
        near.select(F.col("ids_a")[0].alias("head_a"), F.col("ids_b")[0].alias("head_b"), "a", "b", "ids_a", "ids_b")
        .join(texts.select(F.col("id").alias("head_a"), F.col("text").alias("text_a")), "head_a")
        .join(texts.select(F.col("id").alias("head_b"), F.col("text").alias("text_b")), "head_b")
        .filter(_shared_words("text_a", "text_b") >= 8000)
        .select("a", "b", "ids_a", "ids_b")
    )


def similar_contents(df: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """Pairs (id_a, id_b) of texts whose shared words are at least 80 % of all their words."""
    records = content_records(df, key, text)
    bags = distinct_bags(records)
    return _id_pairs(_near_contents(df, bags, key, text), bags, records)


def _near_names(bags: DataFrame) -> DataFrame:
    """Pairs (a, b, ids_a, ids_b) of names that at most 15 % of the longer length in edits turn into one another."""
    found = candidate_pairs(bags, name_budget)
    heads = bags.select("rid", "ids", F.col("bag").cast("string").alias("name"), "n")
    near = found.join(heads.toDF("a", "ids_a", "name_a", "n_a"), "a").join(heads.toDF("b", "ids_b", "name_b", "n_b"), "b")
    return near.filter(F.levenshtein("name_a", "name_b") * 100 <= 15 * F.greatest("n_a", "n_b")).select("a", "b", "ids_a", "ids_b")


def similar_names(df: DataFrame, key: str = "id", name: str = "filename") -> DataFrame:
    """Pairs (id_a, id_b) of names that at most 15 % of the longer length in edits turn into one another."""
    records = name_records(df, key, name)
    bags = distinct_bags(records)
    return _id_pairs(_near_names(bags), bags, records)


# ---------------------------------------------------------------- classes


def classes(pairs: DataFrame, rounds: int = 100) -> DataFrame:
    """Connected classes of pairs (id_a, id_b): one row (id, class_id, links) per id, the class named by its smallest id.

    Large-star and small-star steps in turn hang every id below smaller ones
    until the links of two rounds are the same; each step is an aggregate and a
    join on keys, its result is checkpointed, and the number of rounds grows
    with the logarithm of the longest chain. Classes that don't settle in
    ``rounds`` are an error.
    """
    pairs = checkpointed(pairs.select("id_a", "id_b"))
    both = pairs.unionByName(pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    links = both.distinct().groupBy(F.col("id_a").alias("id")).agg(F.count("*").alias("links"))
    edges = checkpointed(pairs.filter(F.col("id_a") != F.col("id_b")).select(F.greatest("id_a", "id_b").alias("u"), F.least("id_a", "id_b").alias("v")).distinct())
    for _ in range(rounds):
        before = edges
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        small = hung.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.filter(F.col("u") != F.col("v")).distinct())
        if edges.join(before, ["u", "v"], "left_anti").isEmpty() and before.join(edges, ["u", "v"], "left_anti").isEmpty():
            break
    else:
        raise RuntimeError(f"the classes did not settle in {rounds} rounds")
    named = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("class_id"))
    return links.join(named, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), "links")


def _grouped(near: DataFrame, bags: DataFrame, records: DataFrame) -> DataFrame:
    """One row (id, class_id, links) per record, from the classes and sizes of the bags; a record without a link is a class of its own."""
    heads = bags.select("bag", F.col("ids")[0].alias("head"))
    members = checkpointed(records.select("id", "bag").distinct().join(heads, "bag").select("id", "head"))
    size = members.groupBy("head").agg(F.count("*").alias("n"))
    near = checkpointed(near.select(F.col("ids_a")[0].alias("id_a"), F.col("ids_b")[0].alias("id_b")).distinct())
    both = near.unionByName(near.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    others = both.join(size.withColumnRenamed("head", "id_b"), "id_b").groupBy(F.col("id_a").alias("head")).agg(F.sum("n").alias("more"))
    named = classes(near.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))).select(F.col("id").alias("head"), "class_id")
    per_bag = size.join(others, "head", "left").join(named, "head", "left")
    per_bag = per_bag.select("head", F.coalesce("class_id", "head").alias("class_id"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"))
    return members.join(per_bag, "head").select("id", "class_id", "links")


def content_groups(df: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """The class of every text within the size limits, and the number of all texts similar to it."""
    records = content_records(df, key, text)
    bags = distinct_bags(records)
    return _grouped(_near_contents(df, bags, key, text), bags, records)


def name_groups(df: DataFrame, key: str = "id", name: str = "filename") -> DataFrame:
    """The class of every name within the size limits, and the number of all names similar to it."""
    records = name_records(df, key, name)
    bags = distinct_bags(records)
    return _grouped(_near_names(bags), bags, records)
