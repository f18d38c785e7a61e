"""Clusters and nearest vectors against brute force."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import clusters, neighbours
from wordloom.llm.components import components
from wordloom.llm.vectors import packed, unpacked, usable_vectors

T0 = datetime(2024, 1, 1)
SCHEMA = "idx bigint, w string, m_vec array<double>, iteration bigint, trained_at timestamp, unit string, norm double"


def made(n_clusters=25, seed=0):
    """Tight groups, loners, a chain and a third of copies of one vector."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n_clusters):
        centre = rng.normal(size=64)
        for _ in range(rng.integers(2, 9)):
            out.append((centre + 0.25 * rng.normal(size=64)) * rng.uniform(0.1, 10))
    out += list(rng.normal(size=(60, 64)))
    a, b = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
    out += [np.cos(t) * a + np.sin(t) * b for t in np.arange(5) * 0.6]
    out += [out[0] * 1.0] * (len(out) // 2)
    return np.array(out)


def frame(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m / np.linalg.norm(m, axis=1)[:, None])], "idx bigint, unit array<double>")


def brute_clusters(m, least):
    u = m / np.linalg.norm(m, axis=1)[:, None]
    near = u @ u.T >= least
    label = np.arange(len(m))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def test_clusters(spark):
    m = made()
    label = brute_clusters(m, 0.75)
    got = clusters.cluster_members(frame(spark, m), 0.75)
    assert {r.idx: r.cluster for r in got.collect()} == dict(enumerate(label.tolist()))
    pairs = {(r.idx_a, r.idx_b) for r in clusters.cluster_pairs(got).collect()}
    assert pairs == {(i, j) for i in range(len(m)) for j in range(i + 1, len(m)) if label[i] == label[j]}


def test_blocks_and_cells_change_nothing(spark):
    m = made()
    label = dict(enumerate(brute_clusters(m, 0.75).tolist()))
    for p in (clusters.CellParams(block_rows=7, cell_rows=20), clusters.CellParams(sample_rows=80, margin=0.3, cell_rows=10)):
        got = clusters.cluster_members(frame(spark, m), 0.75, p)
        assert {r.idx: r.cluster for r in got.collect()} == label


@pytest.mark.parametrize("size", [800, 6400])
def test_loose_chains_and_couples(spark, size):
    """Chains of 8 and couples just above the bound, in many cells and blocks."""
    rng = np.random.default_rng(size)
    m = rng.normal(size=(size, 64))
    m /= np.linalg.norm(m, axis=1)[:, None]
    follows = np.arange(size) % 8 > 0
    follows[size // 2 :] = np.arange(size - size // 2) % 2 > 0
    for i in np.flatnonzero(follows):
        side = m[i] - (m[i] @ m[i - 1]) * m[i - 1]
        m[i] = 0.77 * m[i - 1] + np.sqrt(1 - 0.77**2) * side / np.linalg.norm(side)
    label = np.maximum.accumulate(np.where(follows, 0, np.arange(size)))
    assert (brute_clusters(m, 0.75) == label).all()
    got = clusters.cluster_members(frame(spark, m), 0.75, clusters.CellParams(cell_rows=20, exact_rows=3_000, exact_cosines=100_000))
    assert {r.idx: r.cluster for r in got.collect()} == dict(enumerate(label.tolist()))


def test_typical_members(spark):
    m = made()
    vectors = frame(spark, m).withColumn("w", F.concat(F.lit("w"), F.col("idx").cast("string")))
    members = clusters.cluster_members(vectors, 0.75)
    rows = clusters.described_clusters(vectors, members).collect()
    label = brute_clusters(m, 0.75)
    u = m / np.linalg.norm(m, axis=1)[:, None]
    for k in set(label.tolist()):
        own = np.flatnonzero(label == k)
        cos = u[own] @ u[own].sum(0) / np.linalg.norm(u[own].sum(0))
        expected = [int(own[i]) for i in sorted(range(len(own)), key=lambda i: (-round(cos[i], 9), own[i]))[:3]]
        got = sorted((r for r in rows if r.cluster == k), key=lambda r: r.place)
        assert [r.idx for r in got] == expected and all(r.size == len(own) and r.w == f"w{r.idx}" for r in got)


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 501), (7, 3), (None, 4)]
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(5)
    got = {r.id: r.root for r in components(df).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert components(df.where("a > 999")).count() == 0


def test_components_by_rounds(spark):
    """Beyond what one task joins."""
    rng = np.random.default_rng(1)
    links = [(i, i + 1) for i in range(60)] + [(int(a), int(b)) for a, b in rng.integers(100, 400, (150, 2))]
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(7)
    few = {r.id: r.root for r in components(df).collect()}
    assert {r.id: r.root for r in components(df, few_links=0).collect()} == few and few[60] == 0


def test_components_of_a_star(spark):
    df = spark.range(1, 3000).select(F.col("id").alias("a"), F.lit(0).cast("bigint").alias("b"))
    assert {r.root for r in components(df).collect()} == {0}


def brute_neighbours(m, k, least):
    """On distinct rows, so that copies of a vector have one and the same
    cosine with it, then expanded."""
    u = (m / np.linalg.norm(m, axis=1)[:, None]).astype(np.float32)
    distinct, at = np.unique(u, axis=0, return_inverse=True)
    s = (distinct.astype(np.float64) @ distinct.T.astype(np.float64))
    np.fill_diagonal(s, 1.0)
    s = s[at][:, at]
    out = {}
    for i in range(len(m)):
        order = sorted((j for j in range(len(m)) if j != i and s[i, j] >= least), key=lambda j: (-s[i, j], j))[:k]
        out[i] = order
    return out


def test_neighbours(spark):
    m = made(40)
    expected = brute_neighbours(m, 3, 0.75)
    got = {}
    rows = neighbours.nearest_vectors(frame(spark, m), 3, 0.75, neighbours.ForestParams(leaf_rows=16)).collect()
    for r in sorted(rows, key=lambda r: (r.idx, -r.cos, r.other)):
        got.setdefault(r.idx, []).append(r.other)
    true = {(i, j) for i, js in expected.items() for j in js}
    have = {(i, j) for i, js in got.items() for j in js}
    assert len(true & have) >= 0.97 * len(true)
    copies = [i for i in range(len(m)) if (m[i] == m[0]).all()]
    for i in copies:
        assert got[i] == [j for j in copies if j != i][:3]


def test_neighbours_in_blocks(spark):
    m = made(40)
    one = neighbours.ForestParams(trees=1, visits=1, leaf_rows=10_000)
    exact = {(r.idx, r.other) for r in neighbours.nearest_vectors(frame(spark, m), 4, 0.2, one).collect()}
    assert exact == {(i, j) for i, js in brute_neighbours(m, 4, 0.2).items() for j in js}
    split = neighbours.ForestParams(trees=1, visits=1, leaf_rows=10_000, block_rows=9)
    assert {(r.idx, r.other) for r in neighbours.nearest_vectors(frame(spark, m), 4, 0.2, split).collect()} == exact


def test_unsettled_searches_are_exact(spark):
    """Lone vectors, where trees find little, with rows and searches in blocks."""
    rng = np.random.default_rng(3)
    m = np.concatenate([made(20), rng.normal(size=(1500, 64))])
    few = neighbours.ForestParams(trees=2, visits=2, leaf_rows=60, exact_rows=400, cosines=20_000)
    expected = {(i, j) for i, js in brute_neighbours(m, 10, -1).items() for j in js}
    loose = {(r.idx, r.other) for r in neighbours.nearest_vectors(frame(spark, m), 10, p=few).collect()}
    assert len(loose & expected) < 0.7 * len(expected)
    got = {(r.idx, r.other) for r in neighbours.nearest_vectors(frame(spark, m), 10, p=few, exact=True).collect()}
    assert len(got) == len(expected) and len(got & expected) >= 0.999 * len(expected)


def brute_density(m, least, min_points):
    u = m / np.linalg.norm(m, axis=1)[:, None]
    cos = u @ u.T
    core = np.flatnonzero((cos >= least).sum(1) >= min_points)
    # Exact copies are one point, also where it is in no cluster.
    out = np.array([np.flatnonzero((m == row).all(1))[0] for row in m])
    label = core.copy()
    near = cos[np.ix_(core, core)] >= least
    while len(core):
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    out[core] = label
    for i in np.setdiff1d(np.arange(len(m)), core):
        best = [(-round(cos[i, c], 6), c) for c in core if cos[i, c] >= least]
        if best:
            out[i] = out[min(best)[1]]
    return out


@pytest.mark.parametrize("min_points", [1, 3, 5, 400])
def test_density(spark, min_points):
    m = made(30, seed=9)
    got = clusters.cluster_members(frame(spark, m), 0.75, clusters.CellParams(exact_rows=50, exact_cosines=2_000), min_points)
    expected = brute_density(m, 0.75, min_points)
    assert {r.idx: r.cluster for r in got.collect()} == dict(enumerate(expected.tolist()))


def test_pairs_of_a_large_cluster(spark):
    members = spark.createDataFrame([(i, 0 if i < 2500 else i) for i in range(2600)], "idx bigint, cluster bigint")
    pairs = clusters.cluster_pairs(members)
    assert pairs.count() == 2500 * 2499 // 2 == pairs.distinct().count()


def test_usable(spark):
    v = [1.0] + [0.0] * 63
    rows = [
        (1, "old", [2.0] * 64, 1, T0, "x", 0.0), (1, "new", [3.0] + [0.0] * 63, 2, T0 + timedelta(1), "x", 0.0),
        (1, "broken", [float("nan")] + v[1:], 3, T0 + timedelta(2), "x", 0.0), (2, None, v, 1, None, None, None),
        (3, "zero", [0.0] * 64, 1, T0, "x", 0.0), (4, "short", [1.0] * 63, 1, T0, "x", 0.0), (5, "null", None, 1, T0, "x", 0.0),
        (6, "gap", [None] + v[1:], 1, T0, "x", 0.0), (7, "infinite", [float("inf")] + v[1:], 1, T0, "x", 0.0), (None, "no", v, 1, T0, "x", 0.0),
        (8, "huge", [1e308] * 64, 1, T0, "x", 0.0), (9, "tiny", [1e-310] * 64, 1, T0, "x", 0.0), (2, None, v, 1, None, None, None),
    ]
    got = {r.idx: r for r in usable_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {1, 2, 8, 9} and got[1].w == "new"
    for r in got.values():
        assert np.linalg.norm(r.unit) == pytest.approx(1)


def test_nothing(spark):
    none = usable_vectors(spark.createDataFrame([], SCHEMA))
    assert clusters.cluster_members(none.select("idx", "unit"), 0.75).count() == 0
    assert neighbours.nearest_vectors(none.select("idx", "unit"), 3).count() == 0
    single = frame(spark, np.ones((1, 64)))
    assert [(r.idx, r.cluster) for r in clusters.cluster_members(single, 0.75).collect()] == [(0, 0)]
    assert neighbours.nearest_vectors(single, 3).count() == 0


def test_packed_rows():
    m = np.arange(128, dtype=np.float32).reshape(2, 64)
    assert (unpacked(packed(m)) == m).all()
    assert (unpacked(packed(m).slice(1)) == m[1:]).all()
    assert unpacked(packed(m[:0])).shape == (0, 64)


@pytest.fixture(scope="module")
def trained(spark):
    """The usable vectors of a test table, and all their cosines."""
    import os

    d = "/root/testdata/sf0.01"
    if not os.path.exists(d):
        pytest.skip("no test tables")
    from wordloom.llm import queries

    rows = queries._vectors(spark, d).orderBy("idx").collect()
    u = np.array([r.unit for r in rows])
    return d, np.array([r.idx for r in rows]), u @ u.T


def test_neighbours_of_trained_vectors(spark, trained):
    from wordloom.llm import queries

    d, ids, cos = trained
    np.fill_diagonal(cos, -1)
    true = set()
    for i, row in enumerate(cos):
        for j in np.argsort(-row)[:3]:
            if row[j] >= 0.75:
                true.add((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    got = {(r.idx_a, r.idx_b) for r in queries.p7_found(spark, d).collect()}
    assert len(got & true) >= 0.99 * len(true) and len(got - true) <= 0.01 * len(got)


def test_clusters_of_trained_vectors(spark, trained):
    from wordloom.llm import queries

    d, ids, cos = trained
    label = np.arange(len(ids))
    near = (cos >= 0.75) | np.eye(len(ids), dtype=bool)
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    true = {(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in range(i + 1, len(ids)) if label[i] == label[j]}
    got = {(r.idx_a, r.idx_b) for r in queries.p4_found(spark, d).collect()}
    assert got <= true and len(got) >= 0.99 * len(true)
