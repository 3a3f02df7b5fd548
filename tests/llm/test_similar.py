import numpy as np

from lodestack.llm import similar as S

SHAPE = "id string, embedding array<float>, vec string, cell int"


def frame(spark, vectors):
    return spark.createDataFrame([(k, None if v is None else [float(x) for x in v], "x", 1) for k, v in vectors], SHAPE)


def brute(vectors, least=0.8):
    good = {k: np.float32(v).astype(float) for k, v in vectors if v is not None and len(v) == 96 and np.isfinite(v).all() and np.any(v)}
    ids = sorted(good)
    u = np.array([good[k] / np.linalg.norm(good[k]) for k in ids])
    s = u @ u.T
    np.fill_diagonal(s, -9)
    out = set()
    for i, row in enumerate(s):
        for j in np.lexsort((np.arange(len(ids)), -np.round(row, 12)))[:5]:
            if row[j] >= least:
                out.add(tuple(sorted((ids[i], ids[j]))))
    return out


def found(spark, vectors, **options):
    return {(r["id_a"], r["id_b"]) for r in S.similar_pairs(S.nearest(frame(spark, vectors), **options)).collect()}


def test_clusters_copies_and_unusable_rows(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(40, 96))
    vectors = [(f"v{i:04}", centers[i % 40] + 0.25 * rng.normal(size=96)) for i in range(600)] + [(f"r{i:04}", rng.normal(size=96)) for i in range(600)]
    vectors += [(f"c{i:02}", centers[0]) for i in range(9)] + [(f"d{i}", 3.5 * np.float32(vectors[5][1])) for i in range(1)]
    vectors += [("n1", None), ("n2", np.zeros(96)), ("n3", np.full(96, np.nan)), ("n4", np.ones(48)), vectors[3]]
    want, got = brute(vectors), found(spark, vectors)
    assert len(want & got) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    copies = {p for p in want if p[0][0] == p[1][0] == "c"}
    assert copies and {p for p in got if p[0][0] == p[1][0] == "c"} == copies


def test_a_third_of_all_rows_share_a_vector(spark):
    rng = np.random.default_rng(2)
    one = rng.normal(size=96)
    vectors = [(f"h{i:04}", one) for i in range(300)] + [(f"r{i:04}", rng.normal(size=96)) for i in range(600)]
    assert found(spark, vectors) == brute(vectors)


def test_tiny_and_empty_tables(spark):
    assert found(spark, []) == set()
    assert found(spark, [("a", np.ones(96))]) == set()
    assert found(spark, [("b", np.ones(96)), ("a", np.ones(96)), ("a", np.ones(96))]) == {("a", "b")}


def test_codes_weigh_the_parallel_error():
    rng = np.random.default_rng(3)
    u = S._unit(rng.normal(size=(500, 96)).astype(np.float32))
    books = S._fit_books(u, u, eta=4.0)
    shift = lambda eta: np.abs(np.einsum("nd,nd->n", u - S._decode(S._pack(S.anisotropic_codes(u, u, books, eta)), books), u)).mean()
    assert shift(4.0) < shift(1.0)


def test_search_recall(spark):
    rng = np.random.default_rng(4)
    vectors = [(f"v{i:05}", rng.normal(size=96)) for i in range(3000)]
    df = frame(spark, vectors)
    got = S.search(df, df.filter("id < 'v00050'")).collect()
    u = np.array([v / np.linalg.norm(v) for _, v in vectors])
    hits = 0
    for q in range(50):
        s = u @ u[q]
        s[q] = -9
        hits += len({f"v{i:05}" for i in np.argsort(-s)[:5]} & {r["other"] for r in got if r["id"] == f"v{q:05}"})
    assert len(got) == 250 and hits >= 0.9 * 250


def test_search_with_repeated_rows_and_equal_vectors(spark):
    rng = np.random.default_rng(5)
    one = rng.normal(size=96)
    near = [one + 0.3 * rng.normal(size=96) for _ in range(12)]
    vectors = [(f"n{i:02}", v) for i, v in enumerate(near)] + [(f"h{i:03}", one) for i in range(200)] + [(f"r{i:03}", rng.normal(size=96)) for i in range(300)]
    vectors += [v for v in vectors if v[0][0] == "n"] * 3 + [vectors[20]] * 4
    order = rng.permutation(len(vectors))
    df = frame(spark, [vectors[i] for i in order])
    got = {}
    for r in S.search(df, df.filter("id in ('n00', 'n05', 'h150', 'h002', 'r007')")).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["other"]
    known = {k: np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) for k, v in vectors}
    for q, hits in got.items():
        want = sorted((k for k in known if k != q), key=lambda k: (-round(float(known[k] @ known[q]), 12), k))[:5]
        assert [hits[i] for i in range(1, 6)] == want
    assert len(got) == 5
    df = frame(spark, [v for v in vectors if v[0][0] == "n"])  # no vector is shared: repeats alone
    rows = S.search(df, df.filter("id = 'n03'"), top=11).collect()
    assert {r["other"] for r in rows} == {f"n{i:02}" for i in range(12)} - {"n03"}


def test_recall_with_many_cells(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL_ROWS", 12)
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(60, 96))
    vectors = [(f"v{i:04}", centers[i % 60] + 0.45 * rng.normal(size=96)) for i in range(2400)]
    want = brute(vectors)
    assert len(want & found(spark, vectors)) >= 0.995 * len(want)


def clustered(rows, clusters, spread, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, 96))
    return [(f"v{i:05}", centers[i % clusters] + spread * rng.normal(size=96)) for i in range(rows)]


def test_exact_setting_finds_every_pair(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL_ROWS", 40)
    vectors = clustered(900, 20, 0.48, 7)
    assert found(spark, vectors, exact=True) == brute(vectors)


def test_second_level_of_centers(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL_ROWS", 12)
    monkeypatch.setattr(S, "LEVEL", 16)
    vectors = clustered(2400, 60, 0.4, 8)
    index = S.fit(S.distinct_vectors(S.usable(frame(spark, vectors))).withColumn("rid", S.F.monotonically_increasing_id()), 2400)
    assert len(index.coarse) == 16 and len(index.fine) == 13
    want = brute(vectors)
    assert len(want & found(spark, vectors)) >= 0.99 * len(want)


def test_the_index_does_not_depend_on_the_partitioning(spark, monkeypatch):
    monkeypatch.setattr(S, "SAMPLE", 400)
    df = frame(spark, clustered(1500, 40, 0.4, 12))
    one, other = (S.fit(S.distinct_vectors(S.usable(df.repartition(n, "id"))), 1500) for n in (1, 7))
    assert np.array_equal(one.coarse, other.coarse) and np.array_equal(one.fine, other.fine) and np.array_equal(one.books, other.books)


def test_a_shared_vector_in_a_large_table_adds_no_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 200)
    monkeypatch.setattr(S, "CELL_ROWS", 400)
    vectors = clustered(6000, 300, 0.3, 9)
    hot = [(f"h{i:05}", vectors[0][1]) for i in range(3000)]
    df = frame(spark, [*vectors, *hot])
    kinds = S.checkpointed(S.distinct_vectors(S.usable(df)).withColumn("rid", S.F.monotonically_increasing_id()))
    assert kinds.count() == 6000
    want = brute(vectors)
    got = {p for p in found(spark, [*vectors, *hot]) if not any(x[0] == "h" for x in p)}
    assert len({p for p in want if "v00000" not in p} & got) >= 0.99 * len(want) - 5
    copies = [r for r in S.nearest(df).filter("id like 'h%'").collect()]
    assert len(copies) == 15000 and all(r["sim"] == 1.0 for r in copies)


def test_table_sums_are_inner_products():
    rng = np.random.default_rng(10)
    books = rng.normal(size=(96, 16, 1)).astype(np.float32)
    packed = rng.integers(0, 256, (50, 48)).astype(np.uint8)
    asked = rng.normal(size=(7, 96)).astype(np.float32)
    sums, slack = S.table_sums(asked, packed, books)
    assert np.abs(sums - S._decode(packed, books) @ asked.T).max() <= slack + 1e-4
