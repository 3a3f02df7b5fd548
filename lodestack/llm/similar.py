"""The most similar vectors of every vector.

Vectors are compared by cosine. The index is fitted on a bounded sample and
holds every row:

* spherical k-means gives the cells; where many rows need more cells than one
  level has, a second level of centers, shared by all cells of the first, cuts
  each of them, so that cells hold about CELL_ROWS rows at any size,
* the direction of a vector's residual to its cell is coded in four bits per
  dimension with score-aware (anisotropic) quantisation: the error
  parallel to the vector, which shifts inner products, costs more than the
  orthogonal one, both when codes are chosen and when codebooks are fitted.

Every vector lives in its nearest cell and visits the next ones. What a
visitor sends to a cell are 48 bytes of codes, a length and the size of the
coding error; its vector goes to its own cell only.
There each visitor's tables are made (one of 256 sums per byte, two four-bit
codes together, in 16-bit integers) and the residents' codes look their sums up.
Pairs that, by SIGMAS standard errors of the coding, can't reach the wanted
similarity or can't be among the most similar of either vector are dropped. The
short list that is left, at most RERANK per vector and cell, is reranked in
double precision: at once where both vectors live in the cell, in a join with
the exact vectors otherwise.

Residents and visitors of a large cell are cut into blocks of BLOCK_ROWS, each
pair of blocks a group of its own, so no group grows with the data. Exact
copies are one vector for the index; their ids are put back afterwards, so that
a vector that a third of all rows share costs no more than another.

:func:`nearest` is approximate; with ``exact=True`` every vector visits every
cell, pairs are dropped only where the largest possible error can't lift them,
and no list is cut: that finds every pair, at quadratic cost.

Defined results: null vectors, vectors of another length, with a null or
non-finite value or of only zeros aren't usable and have no rows; ties go to
the smaller id; repeated rows count once; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.session import checkpointed

DIM, TOP = 96, 5
#: Dimensions that share a four-bit code.
SUB = 1
#: Rows that the index is fitted on, at most (400 bytes each).
SAMPLE = 16_384
#: Rows per cell that the number of cells aims at, and the centers of the first level (the second has as many as it takes, up to SAMPLE).
CELL_ROWS, LEVEL = 500, 1024
#: Cells that a vector is compared in, its own one included: more where there are more cells, as neighbours are spread over more of them.
PROBES, MORE_PROBES = 4, 2
#: Residents and visitors of a cell that one group scans; larger cells are cut into blocks.
BLOCK_ROWS = 16_384
#: Cells larger than a block that are sent to every task (24 bytes each); more are joined.
LARGE_CELLS = 100_000
#: Candidates of the table scan that are reranked, per vector and cell.
RERANK = 64
#: Standard errors of the coding that a pair may be below the wanted similarity and still be reranked.
SIGMAS = 4.0
#: From this share of the norm on, inner products are meant to be exact (the published threshold).
SCORE_THRESHOLD = 0.2
#: Largest sum that 16-bit tables hold.
STEPS = 30_000


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, DIM)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(np.float32)


def usable(df: DataFrame, key: str = "id", embedding: str = "embedding") -> DataFrame:
    """One row (id, vec, print) per usable vector: its 32-bit floats and their 128-bit fingerprint."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            good = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False) & (np.diff(lists.offsets.to_numpy()) == DIM))
            start = lists.offsets.to_numpy()[good]
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.float32)
            rows = values[start[:, None] + np.arange(DIM)] if len(good) else np.zeros((0, DIM), np.float32)
            fine = np.isfinite(rows).all(axis=1) & rows.any(axis=1)
            rows, good = rows[fine], good[fine]
            data = [(r + np.float32(0)).tobytes() for r in rows]  # -0.0 becomes 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(good)), pa.array(data, pa.binary()), pa.array([xxhash.xxh3_128_digest(d) for d in data], pa.binary())],
                names=["id", "vec", "print"],
            )

    source = df.select(F.col(key).cast("string").alias("id"), F.col(embedding).cast("array<float>").alias("embedding")).filter(F.col("id").isNotNull())
    return source.mapInArrow(run, "id string, vec binary, print binary")


def distinct_vectors(vectors: DataFrame, keep: int = TOP + 1) -> DataFrame:
    """One row (ids, vec, print) per different vector, with its ``keep`` smallest ids.

    The rank limit runs before the shuffle as well, so no task ever holds all
    rows of a vector that many share.
    """
    first = Window.partitionBy("print").orderBy("id")
    few = vectors.withColumn("n", F.dense_rank().over(first)).filter(F.col("n") <= keep)
    return few.groupBy("print").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.first("vec").alias("vec"))


@dataclass
class Index:
    """What the fitted index consists of; at most a few MB.

    The cell ``i * len(fine) + j`` has the center ``coarse[i] + fine[j]``.
    """

    coarse: np.ndarray
    fine: np.ndarray
    books: np.ndarray
    eta: float

    def cells(self) -> int:
        return len(self.coarse) * len(self.fine)

    def center(self, cell: np.ndarray) -> np.ndarray:
        return self.coarse[cell // len(self.fine)] + self.fine[cell % len(self.fine)]

    def probes(self, exact: bool = False) -> int:
        """Cells that a vector visits."""
        return self.cells() if exact else PROBES + MORE_PROBES * max(0, int(np.log2(self.cells() / 64) // 3))

    def nearest(self, u: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` nearest cells of each vector, nearest first."""
        to_coarse = np.square(self.coarse).sum(axis=1) - 2 * (u @ self.coarse.T)
        if len(self.fine) == 1:
            return _first(to_coarse, count)
        top = _first(to_coarse, min(len(self.coarse), max(4, count)))
        out = np.empty((len(u), min(count, top.shape[1] * len(self.fine))), np.int64)
        for at in range(0, len(u), 128):  # so that the distances to all second-level centers stay small
            part, some = slice(at, at + 128), top[at : at + 128]
            rest = u[part, None, :] - self.coarse[some]
            far = np.square(rest).sum(axis=2)[:, :, None] + np.square(self.fine).sum(axis=1) - 2 * (rest @ self.fine.T)
            best = _first(far.reshape(len(some), -1), out.shape[1])
            out[part] = np.take_along_axis(some, best // len(self.fine), axis=1) * len(self.fine) + best % len(self.fine)
        return out


def _first(far: np.ndarray, count: int) -> np.ndarray:
    """Column numbers of the ``count`` smallest values per row, smallest first."""
    count = min(count, far.shape[1])
    some = np.argpartition(far, count - 1, axis=1)[:, :count]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, axis=1), axis=1), axis=1)


def _kmeans(x: np.ndarray, cells: int, rounds: int = 8, spherical: bool = True) -> np.ndarray:
    """Centers of ``cells`` clusters: of unit length if ``spherical``, else means."""
    rng = np.random.default_rng(7)
    centers = x[rng.choice(len(x), cells, replace=False)].copy()
    for _ in range(rounds):
        nearest = (x @ centers.T - (0 if spherical else np.square(centers).sum(axis=1) / 2)).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, x)
        count = np.bincount(nearest, minlength=cells)
        empty = count == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        norms = np.linalg.norm(sums, axis=1, keepdims=True) if spherical else np.maximum(count, 1)[:, None]
        centers = np.where(norms > 1e-6, sums / np.maximum(norms, 1e-6), centers)
    return centers.astype(np.float32)


def _residuals(u: np.ndarray, center: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit direction and length of what remains of ``u`` beside the center of its cell."""
    rest = u - center
    size = np.linalg.norm(rest, axis=1)
    return rest / np.maximum(size, 1e-12)[:, None], size


def anisotropic_codes(direction: np.ndarray, u: np.ndarray, books: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """Four-bit codes (one per subspace) that minimise the score-aware loss by coordinate descent.

    The loss of a row is its squared error plus ``eta - 1`` times the squared
    part of the error that is parallel to the row's vector ``u``.
    """
    n, parts = len(direction), len(books)
    d, v = direction.reshape(n, parts, SUB), u.reshape(n, parts, SUB)
    off = d[:, :, None, :] - books[None]
    square, along = np.einsum("nspd,nspd->nsp", off, off), np.einsum("nspd,nsd->nsp", off, v)
    codes = square.argmin(axis=2)
    rows = np.arange(n)
    total = np.take_along_axis(along, codes[:, :, None], axis=2)[:, :, 0].sum(axis=1)
    for _ in range(sweeps):
        for s in range(parts):
            others = total - along[rows, s, codes[:, s]]
            codes[:, s] = (square[:, s] + (eta - 1) * np.square(others[:, None] + along[:, s])).argmin(axis=1)
            total = others + along[rows, s, codes[:, s]]
    return codes.astype(np.uint8)


def _fit_books(direction: np.ndarray, u: np.ndarray, eta: float, rounds: int = 2) -> np.ndarray:
    """Codebooks that minimise the score-aware loss: codes and codebooks are improved in turns."""
    n, parts, size = len(direction), DIM // SUB, 16
    rng = np.random.default_rng(11)
    picks = rng.integers(0, n, (parts, size))
    d = direction.reshape(n, parts, SUB)
    books = d[picks, np.arange(parts)[:, None]].astype(np.float32) + rng.normal(0, 1e-4, (parts, size, SUB)).astype(np.float32)
    for _ in range(4):  # plain k-means per subspace as the start
        codes = ((d[:, :, None, :] - books[None]) ** 2).sum(axis=3).argmin(axis=2)
        for s in range(parts):
            count = np.bincount(codes[:, s], minlength=size)
            for k in range(SUB):
                sums = np.bincount(codes[:, s], weights=d[:, s, k], minlength=size)
                books[s, :, k] = np.where(count > 0, sums / np.maximum(count, 1), books[s, :, k])
    along = np.einsum("nd,nd->n", direction, u)
    for _ in range(rounds):
        codes = anisotropic_codes(direction, u, books, eta).astype(np.int64)
        place = ((np.arange(parts) * size + codes) * SUB)[:, :, None] + np.arange(SUB)
        weights = np.zeros((n, parts * size * SUB), np.float32)
        weights[np.arange(n)[:, None, None], place] = u.reshape(n, parts, SUB)
        right = (eta - 1) * (weights.T @ along)
        np.add.at(right, place.ravel(), d.ravel())
        count = np.bincount(place.ravel(), minlength=parts * size * SUB)
        left = (eta - 1) * (weights.T @ weights) + np.diag(count + 1e-3)
        books = np.linalg.solve(left.astype(np.float64), right + 1e-3 * books.ravel()).reshape(parts, size, SUB).astype(np.float32)
    return books


def fit(kinds: DataFrame, rows: int) -> Index | None:
    """The index of ``rows`` different vectors (vec), fitted on a hash sample of at most SAMPLE of them.

    The sample and its order follow from the vectors alone, so the same rows
    give the same index however they are partitioned.
    """
    share = min(1.0, 0.95 * SAMPLE / max(rows, 1))
    place = F.pmod(F.xxhash64("vec"), F.lit(1 << 30))
    chosen = kinds.filter(place < int(share * (1 << 30)) + 1).select("vec", place.alias("place")).orderBy("place", "vec").limit(SAMPLE).toArrow()
    if chosen.num_rows == 0:
        return None
    u = _unit(_matrix(chosen.column("vec")))
    cells = max(1, rows // CELL_ROWS)
    coarse = _kmeans(u, min(cells, LEVEL, len(u)))
    rest = u - coarse[(u @ coarse.T).argmax(axis=1)]
    second = min(-(-cells // LEVEL), len(u))
    fine = _kmeans(rest, second, spherical=False) if second > 1 else np.zeros((1, DIM), np.float32)
    index = Index(coarse, fine, np.zeros((DIM // SUB, 16, SUB), np.float32), (DIM - 1) * SCORE_THRESHOLD**2 / (1 - SCORE_THRESHOLD**2))
    few = u[:4096]
    direction, _ = _residuals(few, index.center(index.nearest(few, 1)[:, 0]))
    index.books = _fit_books(direction, few, index.eta)
    return index


# ------------------------------------------------------------ codes and tables


def _pack(codes: np.ndarray) -> np.ndarray:
    return codes[:, 0::2] | (codes[:, 1::2] << 4)


def _decode(packed: np.ndarray, books: np.ndarray) -> np.ndarray:
    codes = np.empty((len(packed), packed.shape[1] * 2), np.uint8)
    codes[:, 0::2], codes[:, 1::2] = packed & 15, packed >> 4
    return books[np.arange(codes.shape[1]), codes].reshape(len(packed), DIM)


def table_sums(asked: np.ndarray, packed: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, float]:
    """Inner products of the vectors ``asked`` with the coded directions ``packed``, by table scan, and how far off they may be.

    Per asked vector and byte there is a table of 256 sums, those of the two
    four-bit codes in the byte, in steps that fit 16-bit integers. The tables
    of all asked vectors lie side by side, so that a code fetches one row of
    them. The result has a row per code.
    """
    n, parts = len(asked), len(books)
    single = np.einsum("nsd,skd->skn", asked.reshape(n, parts, SUB), books)
    step = max(float(np.abs(single).max(axis=1).sum(axis=0).max(initial=0.0)), 1e-9) / STEPS
    paired = np.rint((single[0::2][:, None, :, :] + single[1::2][:, :, None, :]) / step).astype(np.int16).reshape(parts // 2, 256, n)
    sums = paired[0][packed[:, 0]]
    for byte in range(1, parts // 2):
        sums += paired[byte][packed[:, byte]]
    return sums * np.float32(step), parts / 4 * step


def _coded(index: Index, u: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, ...]:
    """Codes of unit vectors in their cells, the length of the coded residual, and the error's part along the vector and whole length."""
    center = index.center(cell)
    direction, size = _residuals(u, center)
    packed = _pack(anisotropic_codes(direction, u, index.books, index.eta))
    error = u - (center + _decode(packed, index.books) * size[:, None])
    return packed, size, np.einsum("nd,nd->n", error, u), np.linalg.norm(error, axis=1)


def _spread(along: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A vector's share in the variance of an inner product, once the parallel error is put right: a part that counts by the squared sine, and one that always counts.

    The orthogonal error points anywhere in its DIM - 1 dimensions; the product
    of two vectors' errors is at most the mean of their fourth powers.
    """
    return (np.square(off) - np.square(along)) * (SIGMAS**2 / (DIM - 1)), off**4 * (SIGMAS**2 / (2 * (DIM - 1)))


_PLACED = "cell bigint, home boolean, rid bigint, own bigint, codes binary, size float, along float, off float, vec binary"


def _place(index, probes: int):
    """A row for each cell that a vector is compared in; the ``home`` one, in its own cell, brings the vector along."""

    def run(batches):
        model = index.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                u = _unit(_matrix(part.column(1)))
                cells = model.nearest(u, probes)
                packed, size, along, off = _coded(model, u, cells[:, 0])
                row, home = np.repeat(np.arange(len(u)), cells.shape[1]), np.tile(np.arange(cells.shape[1]) == 0, len(u))
                take = pa.array(row)
                columns = [pa.array(cells.ravel()), pa.array(home), part.column(0).take(take), pa.array(cells[:, 0]).take(take)]
                columns += [pa.array([c.tobytes() for c in packed], pa.binary()).take(take), *(pa.array(x.astype(np.float32)).take(take) for x in (size, along, off))]
                columns.append(part.column(1).take(pa.array(row, mask=~home)))
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "home", "rid", "own", "codes", "size", "along", "off", "vec"])

    return run


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the ``k`` largest values per row."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sim", pa.float64())])


def _strongest(keep: np.ndarray, scores: np.ndarray, error: np.ndarray, top: int, most: int) -> np.ndarray:
    """Of the kept entries of each row those that can be among its ``top`` largest by their errors, and at most ``most``."""
    out = keep.copy()
    crowded = np.flatnonzero(keep.sum(axis=1) > top)
    if len(crowded):
        s, e = np.where(keep[crowded], scores[crowded], -9.0), error[crowded]
        sure = -np.partition(e - s, top - 1, axis=1)[:, top - 1 : top]
        few = keep[crowded] & (s + e >= sure)
        full = np.flatnonzero(few.sum(axis=1) > most)
        if len(full):
            cut = np.zeros((len(full), few.shape[1]), bool)
            np.put_along_axis(cut, _best(np.where(few[full], s[full], -9.0), most), True, axis=1)
            few[full] = cut
        out[crowded] = few
    return out


def _among_top(pairs: np.ndarray, sim: np.ndarray, top: int) -> np.ndarray:
    """Whether a pair is among the ``top`` most similar of one of its ends; pairs equal to the last of them are too."""
    ends, sims = pairs.T.ravel(), np.tile(sim, 2)
    order = np.lexsort((-sims, ends))
    start = np.flatnonzero(np.diff(ends[order], prepend=-1))
    last = np.minimum(start + top, np.append(start[1:], len(order))) - 1
    least = np.repeat(sims[order][last], np.diff(np.append(start, len(order))))
    good = np.empty(len(order), bool)
    good[order] = sims[order] >= least - 1e-12
    return good[: len(sim)] | good[len(sim) :]


def _scan(index, least: float, top: int, rerank: int, exact: bool):
    """Table scan of one block of a cell's residents by one block of its visitors: pairs (a, b, sim).

    Pairs whose vectors are both here get their exact ``sim``; those of a
    visitor that only sent its codes have none yet.

    A pair stays if, within SIGMAS standard errors of its sum, it can reach
    ``least`` and be among the ``top`` of its visitor or its resident. With
    ``exact`` it stays if the largest error that there can be lifts it to
    ``least``.
    """

    def run(table: pa.Table) -> pa.Table:
        model = index.value
        column = lambda name: table.column(name).to_numpy()
        packed = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        rid, size, along, off = column("rid"), column("size"), column("along"), column("off")
        by_sine, always = _spread(along, off)
        worst = np.abs(along) + np.sqrt(np.maximum(np.square(off) - np.square(along), 0) * (1 - least**2))
        resident, visitor = (np.flatnonzero(table.column(c).to_numpy(zero_copy_only=False).astype(bool)) for c in ("resident", "visitor"))
        center = model.center(column("cell")[:1])[0]
        codes, r_size = packed[resident], size[resident, None]
        at_home = table.column("vec").is_valid().to_numpy(zero_copy_only=False)
        found, local = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
        for at in range(0, len(visitor) if len(resident) else 0, 512):
            v = visitor[at : at + 512]
            asked = model.center(column("own")[v]) + _decode(packed[v], model.books) * size[v, None]
            sums, slack = table_sums(asked, codes, model.books)
            scores = sums * r_size + asked @ center
            if exact:
                error = worst[v] + worst[resident, None] + off[v] * off[resident, None]
            else:
                scores *= 1 + along[v] + along[resident, None]
                error = np.sqrt((by_sine[v] + by_sine[resident, None]) * (1 - np.square(np.clip(scores, least, 1))) + always[v] + always[resident, None])
            error += slack * r_size
            keep = (scores + error >= least - 1e-5) & (rid[resident][:, None] != rid[v])
            if not exact:
                keep = _strongest(keep, scores, error, top, rerank) | _strongest(keep.T, scores.T, error.T, top, rerank).T
            r, q = np.nonzero(keep)
            pair = np.sort(np.stack([resident[r], v[q]], axis=1), axis=1)
            here = at_home[pair].all(axis=1)
            local.append(pair[here])
            found.append(pair[~here])
        local, found = np.unique(np.concatenate(local), axis=0), np.unique(np.concatenate(found), axis=0)
        sim = np.zeros(len(local))
        if len(local):
            row = np.cumsum(at_home) - 1
            wide = _matrix(table.column("vec").filter(pa.array(at_home))).astype(np.float64)
            wide /= np.linalg.norm(wide, axis=1, keepdims=True)
            for at in range(0, len(local), 65536):
                x, y = row[local[at : at + 65536]].T
                sim[at : at + 65536] = np.einsum("nd,nd->n", wide[x], wide[y])
        good = (sim >= least) if exact else (sim >= least) & _among_top(local, sim, top)
        ends = rid[np.concatenate([local[good], found])]
        sims = pa.array(np.concatenate([sim[good], np.zeros(len(found))]), mask=np.arange(len(ends)) >= good.sum())
        return pa.Table.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1)), sims], schema=_PAIR)

    return run


def scanned(kinds: DataFrame, index, probes: int, least: float, top: int, rerank: int, exact: bool = False) -> DataFrame:
    """Pairs (a, b, sim) of the different vectors ``kinds`` (rid, vec) that the table scans leave; see :func:`_scan`."""
    place = lambda rows: rows.select("rid", "vec").mapInArrow(_place(index, probes), _PLACED)
    # How large cells are only decides how work is cut, so a hash sample of the vectors is enough to tell.
    sampled = 64
    sample = place(kinds.filter(F.pmod(F.xxhash64("rid"), F.lit(sampled)) == 0)).groupBy("cell")
    size = lambda n: F.ceil(n * sampled / BLOCK_ROWS)
    large = sample.agg(size(F.count_if("home")).alias("res"), size(F.count("*")).alias("vis")).filter((F.col("res") > 1) | (F.col("vis") > 1)).fillna(1)
    large = checkpointed(large.select("cell", F.greatest("res", F.lit(1)).alias("res"), F.greatest("vis", F.lit(1)).alias("vis")))
    few = large.count() <= LARGE_CELLS
    cut = place(kinds).join(F.broadcast(large) if few else large, "cell", "left").fillna(1, ["res", "vis"])
    cut = cut.withColumn("r", F.pmod(F.xxhash64("rid"), F.col("res"))).withColumn("v", F.pmod(F.hash("rid"), F.col("vis")))
    spot = lambda r, v, resident, visitor: F.struct(r.alias("r"), v.alias("v"), resident.alias("resident"), F.lit(visitor).alias("visitor"))
    count = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    visits = F.transform(count(F.col("res")), lambda i: spot(i, F.col("v"), F.col("home") & (i == F.col("r")), True))
    lives = F.transform(F.filter(count(F.col("vis")), lambda j: F.col("home") & (j != F.col("v"))), lambda j: spot(F.col("r"), j, F.lit(True), False))
    row = ["cell", "rid", "own", "codes", "size", "along", "off"]
    groups = cut.select(*row, "vec", F.explode(F.concat(visits, lives)).alias("at"))
    groups = groups.select(*row, F.when(F.col("at.resident"), F.col("vec")).alias("vec"), "at.*")
    return groups.groupBy("cell", "r", "v").applyInArrow(_scan(index, least, top, rerank, exact), "a bigint, b bigint, sim double")


def _cosines(batches):
    """Exact cosines in double precision: (ids_a, ids_b, sim) of batches (ids_a, ids_b, vec_a, vec_b)."""
    for batch in batches:
        x, y = (_matrix(batch.column(c)).astype(np.float64) for c in (2, 3))
        sim = np.einsum("nd,nd->n", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim)], names=["ids_a", "ids_b", "sim"])


def nearest(df: DataFrame, *, key: str = "id", embedding: str = "embedding", least: float = 0.8, top: int = TOP, rerank: int = RERANK, exact: bool = False) -> DataFrame:
    """One row (id, other, sim) for the ``top`` most similar others of every usable vector, where ``sim`` is at least ``least``."""
    spark = df.sparkSession
    vectors = usable(df, key, embedding)
    kinds = checkpointed(distinct_vectors(vectors, top + 1).withColumn("rid", F.monotonically_increasing_id()))
    model = fit(kinds, kinds.count())
    if model is None:
        return spark.createDataFrame([], "id string, other string, sim double")
    index = spark.sparkContext.broadcast(model)
    pairs = checkpointed(scanned(kinds, index, model.probes(exact), least, top, rerank, exact).groupBy("a", "b").agg(F.max("sim").alias("sim")))
    a, b = (kinds.select(F.col("rid").alias(side), F.col("ids").alias(f"ids_{side}"), F.col("vec").alias(f"vec_{side}")) for side in "ab")
    apart = pairs.filter(F.col("sim").isNull()).select("a", "b").join(a, "a").join(b, "b")
    apart = apart.select("ids_a", "ids_b", "vec_a", "vec_b").mapInArrow(_cosines, "ids_a array<string>, ids_b array<string>, sim double").filter(F.col("sim") >= least)
    met = pairs.filter(F.col("sim").isNotNull()).join(a.drop("vec_a"), "a").join(b.drop("vec_b"), "b").select("ids_a", "ids_b", "sim")
    near = checkpointed(met.unionByName(apart))
    both = near.unionByName(near.select(F.col("ids_b").alias("ids_a"), F.col("ids_a").alias("ids_b"), "sim"))
    order = Window.partitionBy(F.col("ids_a")[0]).orderBy(F.desc("sim"), F.col("ids_b")[0])
    first = both.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= top)
    between = first.select(F.explode("ids_a").alias("id"), "ids_b", "sim").select("id", F.explode("ids_b").alias("other"), "sim")

    copies = kinds.filter(F.size("ids") > 1).select("print", "ids")
    lists = between.unionByName(copies.select(F.explode("ids").alias("id"), "ids").select("id", F.explode("ids").alias("other"), F.lit(1.0).alias("sim")))
    many = copies.filter(F.size("ids") > top)
    if not many.isEmpty():  # the other rows of a vector that many share: each has the vector's first ids as neighbours
        beyond = vectors.select("id", "print").join(many, "print")
        lists = lists.unionByName(beyond.select("id", F.explode("ids").alias("other"), F.lit(1.0).alias("sim")))
    lists = lists.filter(F.col("id") != F.col("other")).groupBy("id", "other").agg(F.max("sim").alias("sim"))
    best = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    return lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("id", "other", "sim")


#: Query vectors that are sent to the executors at once (20 MB).
QUERY_BLOCK = 50_000


def _search(index, ids: list[str], queries: np.ndarray, top: int, rerank: int):
    """Table scan and rerank of the different vectors of each batch: (id, others, sim)."""

    def run(batches):
        model = index.value
        unit = _unit(queries)
        wide = queries.astype(np.float64) / np.linalg.norm(queries.astype(np.float64), axis=1, keepdims=True)
        for batch in batches:
            x = _matrix(batch.column(1))
            u = _unit(x)
            cell = model.nearest(u, 1)[:, 0]
            packed, size = (np.concatenate(x) for x in zip(*(_coded(model, u[i : i + 4096], cell[i : i + 4096])[:2] for i in range(0, len(u), 4096)), strict=True))
            center = model.center(cell)
            full = x.astype(np.float64)
            full /= np.linalg.norm(full, axis=1, keepdims=True)
            for at in range(0, len(unit), 256):
                asked = unit[at : at + 256]
                best = _best((table_sums(asked, packed, model.books)[0] * size[:, None] + center @ asked.T).T, rerank)
                exact = np.einsum("qd,qkd->qk", wide[at : at + 256], full[best])
                place = _best(exact, top + 1)  # one more, for the query itself
                rows = np.take_along_axis(best, place, axis=1)
                names = pa.array([ids[i] for i in range(at, at + len(exact))]).take(pa.array(np.repeat(np.arange(len(exact)), rows.shape[1])))
                yield pa.RecordBatch.from_arrays([names, batch.column(0).take(pa.array(rows.ravel())), pa.array(np.take_along_axis(exact, place, axis=1).ravel())], names=["id", "others", "sim"])

    return run


def search(df: DataFrame, queries: DataFrame, *, key: str = "id", embedding: str = "embedding", top: int = TOP, rerank: int = RERANK) -> DataFrame:
    """One row (id, other, sim, rank) for the ``top`` most similar others of each query, found among all rows of ``df``.

    Unlike :func:`nearest` it has no least similarity and skips no cell: the
    four-bit tables of all different vectors are scanned, and the best ``rerank``
    of each batch are compared exactly; the ids of equal vectors are put back
    afterwards. Queries go in blocks of QUERY_BLOCK; each block
    scans the stored rows once.
    """
    spark = df.sparkSession
    vectors = usable(df, key, embedding)
    kinds = checkpointed(distinct_vectors(vectors, top + 1).select("ids", "vec", F.monotonically_increasing_id().alias("rid")))
    asked = usable(queries, key, embedding).select("id", "vec").dropDuplicates(["id"])
    model = fit(kinds, kinds.count())
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = spark.createDataFrame([], "id string, others array<string>, sim double")
    if model is None:
        return found.select("id", F.lit("").alias("other"), "sim", F.lit(1).alias("rank"))
    index = spark.sparkContext.broadcast(model)
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow()
        if part.num_rows:
            found = found.unionByName(kinds.select("ids", "vec").mapInArrow(_search(index, part.column("id").to_pylist(), _matrix(part.column("vec")), top, rerank), "id string, others array<string>, sim double"))
    best = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    lists = found.select("id", F.explode("others").alias("other"), "sim").filter(F.col("id") != F.col("other")).groupBy("id", "other").agg(F.max("sim").alias("sim"))
    return lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """Pairs (id_a, id_b), smaller id first, of which one is among the nearest of the other."""
    return neighbours.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
