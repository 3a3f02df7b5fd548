"""Exact nearest neighbours of batches of query vectors.

Each Arrow batch of stored vectors is one matrix product with the queries, and
only its best ``k`` rows per query go on; a window picks the final ones. The
queries travel as a broadcast while they are few (checked); more of them are
taken in blocks, each of which scans the stored vectors once.

Ties go to the smaller id. Null vectors, other lengths than the queries' and
vectors of length zero can't be found. Scores are rounded to 6 digits before
ranking, so that the order doesn't hang on the last bits of a sum.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors per block, each of which scans the stored vectors once: at 1,024 dimensions 67 MB.
BLOCK = 8192


def _units(lists: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and unit vectors of the usable rows."""
    ends = lists.offsets.to_numpy()
    good = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False) & (np.diff(ends) == dim))
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat[ends[good][:, None] + np.arange(dim)] if len(good) else np.zeros((0, dim))
    size = np.linalg.norm(rows, axis=1)
    fine = np.isfinite(size) & (size > 0)
    return good[fine], rows[fine] / size[fine][:, None]


def _top(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the ``k`` largest entries of each row, exactly ``k`` where there are as many; of equal ones the first columns."""
    if scores.shape[1] <= k:
        q, at = np.nonzero(np.ones_like(scores, bool))
        return q, at, scores[q, at]
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    above, equal = scores > least, scores == least
    room = k - above.sum(axis=1, keepdims=True)
    q, at = np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= room)))
    return q, at, scores[q, at]


def _scan(ids: list, units: np.ndarray, k: int, out: pa.Schema, groups: list | None = None):
    number = {g: i for i, g in enumerate(dict.fromkeys(g for g in groups or [] if g is not None))}
    wanted = np.array([number.get(g, -1) for g in groups or []])  # -1 asks for all groups

    def run(batches):
        for batch in batches:
            rows, vectors = _units(batch.column(1), units.shape[1])
            if not len(rows):
                continue
            by_key = np.asarray(pc.sort_indices(batch.column(0).take(pa.array(rows))))  # smaller keys first, for ties
            rows, vectors = rows[by_key], vectors[by_key]
            for at in range(0, len(units), 512):
                near = np.round(units[at : at + 512] @ vectors.T, 6)
                if groups is not None:
                    own = np.array([number.get(g, -2) for g in batch.column(2).take(pa.array(rows)).to_pylist()])
                    mine = wanted[at : at + 512, None]
                    near[(mine >= 0) & (mine != own[None, :])] = -9.0
                q, found, scores = _top(near, k)
                inside = scores > -9.0
                q, found, scores = q[inside], found[inside], scores[inside]
                columns = [pa.array([ids[at + i] for i in q], out.field(0).type), batch.column(0).take(pa.array(rows[found])), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return run


def knn(queries: DataFrame, stored: DataFrame, k: int, qid: str = "qid", key: str = "id", embedding: str = "embedding", exclude_self: bool = False, group: str | None = None) -> DataFrame:
    """One row (qid, key, score, rank) per query and each of its ``k`` most similar stored vectors.

    ``queries`` has (qid, embedding), ``stored`` (key, embedding); filters on
    either are the caller's, before the call, and reach the scan. ``group``
    names a text column of both: a query that has a value finds only rows with it.
    """
    q_type, s_type = queries.schema[qid].dataType, stored.schema[key].dataType
    shape = f"qid {q_type.simpleString()}, `{key}` {s_type.simpleString()}, score double"
    out = stored.sparkSession.createDataFrame([], shape).toArrow().schema
    extra = [] if group is None else [F.trim(group).alias("g")]
    vectors = stored.select(F.col(key), F.col(embedding).cast("array<double>"), *extra)
    asked = queries.select(F.col(qid).alias("qid"), F.col(embedding).cast("array<double>").alias("v"), *extra).filter(F.size("v") > 0).distinct()
    n = asked.count()
    blocks = max(1, -(-n // BLOCK))
    found = []
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toArrow().combine_chunks()
        ids = part.column("qid").to_pylist()
        if not ids:
            continue
        lists = part.column("v").combine_chunks()
        rows, units = _units(lists, len(lists[0].as_py()))
        groups = None if group is None else [part.column("g")[int(i)].as_py() for i in rows]
        found.append(vectors.mapInArrow(_scan([ids[i] for i in rows], units, k + exclude_self, out, groups), shape))
    if not found:
        return stored.sparkSession.createDataFrame([], shape + ", rank bigint")
    hits = reduce(DataFrame.unionByName, found).filter(F.col("score").isNotNull())
    if exclude_self:
        hits = hits.filter(F.col("qid") != F.col(key))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), key)
    return hits.withColumn("rank", F.row_number().over(best).cast("bigint")).filter(F.col("rank") <= k)


def lsh_candidates(queries: DataFrame, stored: DataFrame, k: int = 5, bands: int = 24, bits: int = 8, seed: int = 3, key: str = "id", exclude_self: bool = False) -> DataFrame:
    """Approximate alternative: the ``k`` best (qid, key, score, rank) per query among the vectors that share a bucket with it.

    A bucket is the signs of ``bits`` random projections of one band; a query
    looks in its own bucket of every band and in those one sign away.
    ``queries`` (qid, embedding), ``stored`` (key, embedding). Only ids meet in
    buckets; what is found there is ranked by the exact cosine. It misses rows
    by nature; the exact scan is the default.
    """

    def signed(df: DataFrame, name: str, probes: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
        def run(batches):
            for batch in batches:
                lists = batch.column(1)
                dim = next((len(v) for v in lists.to_pylist() if v), 0)
                rows, units = _units(lists, dim)
                planes = np.random.default_rng(seed).normal(size=(dim, bands * bits))
                signs = (units @ planes > 0).reshape(len(rows), bands, bits) @ (1 << np.arange(bits)) if len(rows) else np.zeros((0, bands), np.int64)
                keys = (np.arange(bands) << bits)[None, :, None] + (signs[:, :, None] ^ np.array(probes))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(keys.reshape(len(rows), bands * len(probes)).tolist(), pa.list_(pa.int64())), pa.array(list(units), pa.list_(pa.float64()))], names=[name, "band", "unit"]
                )

        kind = df.schema[df.columns[0]].dataType.simpleString()
        made = df.withColumn(df.columns[1], F.col(df.columns[1]).cast("array<double>")).mapInArrow(run, f"`{name}` {kind}, band array<bigint>, unit array<double>")
        return made.select(name, F.explode("band").alias("band")), made.select(name, "unit").dropDuplicates([name])

    asked, q_units = signed(queries, "qid", (0, *(1 << i for i in range(bits))))
    placed, units = signed(stored, key, (0,))
    met = asked.join(placed, "band").select("qid", key).distinct()
    if exclude_self:
        met = met.filter(F.col("qid") != F.col(key))
    score = F.aggregate(F.zip_with("q_unit", "unit", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = met.join(q_units.withColumnRenamed("unit", "q_unit"), "qid").join(units, key).select("qid", key, F.round(score, 6).alias("score"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(best).cast("bigint")).filter(F.col("rank") <= k)
