import itertools
import random

import numpy as np
import pytest

from sylvan.operators import triangles as ops


def brute(pairs):
    """Support and level of each pair, by recounting all triangles."""
    left, levels, support, k = set(pairs), {}, None, 0
    while left:
        near = {}
        for a, b in left:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        low = {(a, b): len(near[a] & near[b]) for a, b in left}
        support = support or low
        k = max(k, min(low.values()))
        gone = {p for p in left if low[p] <= k}
        levels |= dict.fromkeys(gone, k)
        left -= gone
    return {p: (support[p], levels[p]) for p in pairs}


def random_pairs(seed, n, share, first=0):
    r = random.Random(seed)
    return [(a + first, b + first) for a, b in itertools.combinations(range(n), 2) if r.random() < share]


@pytest.fixture
def tables(monkeypatch):
    """Names of the tables that truss writes."""
    names = []
    monkeypatch.setattr(ops, "materialize", lambda df, name="step", write=ops.materialize: names.append(name) or write(df, name))
    return names


def result(df):
    return {(r.src, r.dst): (r.support, r.k) for r in df.collect()}


def test_truss_keeps_no_table_of_triangles(spark, tables):
    """2,275,280 triangles, in one task by its 28,680 edges."""
    pairs = list(itertools.combinations(range(240), 2))
    assert result(ops.truss(spark.createDataFrame(pairs, "src bigint, dst bigint"))) == dict.fromkeys(pairs, (238, 238))
    assert not {"triangles", "hit"} & set(tables)


@pytest.mark.parametrize("matrix", [True, False])
def test_peel_by_matrix_and_by_lists(monkeypatch, matrix):
    from sylvan.operators import local

    monkeypatch.setattr(local, "MATRIX_VERTICES", 4096 if matrix else 0)
    monkeypatch.setattr(local, "CANDIDATES", 50)
    for seed, n, share in ((1, 40, 0.5), (2, 25, 0.9), (3, 60, 0.1), (4, 3, 1), (5, 2, 1)):
        pairs = [(b * 10**12 - 7, -a) if a % 2 else (-a, b * 10**12 - 7) for a, b in random_pairs(seed, n, share)]
        pairs = sorted({(min(p), max(p)) for p in pairs})
        src, dst = np.array(pairs).T
        assert local.Triangles(src, dst).matrix == matrix
        support, k = local.peel_levels(src, dst)
        assert dict(zip(pairs, zip(support.tolist(), k.tolist(), strict=True), strict=True)) == brute(pairs)


def test_components_are_peeled_apart(spark, tables, monkeypatch):
    """Small components share tasks, others have their own; none goes through rounds."""
    monkeypatch.setattr(ops, "SHARED_EDGES", 30)
    pairs = [*random_pairs(1, 16, 0.7), *random_pairs(2, 30, 0.4, 100), *random_pairs(3, 6, 0.8, 200), (-5, -4), (300, 301)]
    assert result(ops.truss(spark.createDataFrame(pairs, "src bigint, dst bigint"), 400)) == brute(pairs)
    assert result(ops.truss(spark.createDataFrame(pairs, "src bigint, dst bigint"), 200)) == brute(pairs)
    assert not {"bounds", "triangles"} & set(tables)
    assert result(ops.truss(spark.createDataFrame([], "src bigint, dst bigint"))) == {}


def test_rounds_are_few(spark, tables):
    """Three copies of a graph that peeling takes in 16 rounds; and tasks of several colours."""
    pairs = [p for first in (0, 100, -100) for p in random_pairs(9, 48, 0.6, first)]
    df, want = spark.createDataFrame(pairs, "src bigint, dst bigint"), brute(pairs)
    assert result(ops.truss(df, 20)) == want
    assert len(tables) < 40 and tables.count("bounds") > 2
    assert result(ops.truss(df, 20, 600)) == want


def test_ties_of_lines_are_settled(spark, tmp_path):
    """Two lines of an order with one number and part: the supplier decides, however the rows lie."""
    from sylvan.plans.graph_queries import _neighbours

    rows = [(1, 7, 1, 1), (1, 8, 5, 2), (1, 8, 3, 2), (1, 9, 4, 3)]
    for i, order in enumerate((rows, rows[::-1])):
        spark.createDataFrame(order, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int").coalesce(1).write.parquet(f"{tmp_path}/{i}/lineitem.parquet")
        assert {tuple(r) for r in _neighbours(spark, f"{tmp_path}/{i}").collect()} == {(1, 3), (3, 5), (4, 5)}


def test_dense_components_sink_together(monkeypatch):
    """Bounds of all edges sink level by level; no edge is peeled on its own."""
    from sylvan.operators import local

    peel = local.peel_levels
    monkeypatch.setattr(local, "peel_levels", None)
    for seed, n, share in ((1, 90, 0.5), (2, 70, 0.95), (3, 130, 0.2), (4, 3, 1), (5, 2, 1)):
        pairs = random_pairs(seed, n, share, -9)
        src, dst = np.array(pairs).T
        support, k = local.levels(src, dst)
        assert dict(zip(pairs, zip(support.tolist(), k.tolist(), strict=True), strict=True)) == brute(pairs)
    # A random graph of 1500 vertices and 337,000 edges, most of which fall at the last two levels.
    src, dst = np.nonzero(np.triu(np.random.default_rng(1).random((1500, 1500)) < 0.3, 1))
    assert all((x == y).all() for x, y in zip(local.levels(src, dst), peel(src, dst), strict=True))


def test_rounds_move_blocks(spark, monkeypatch):
    """A round writes a row for each pair of colours, not for each edge."""
    rows = []

    def write(df, name="step", materialize=ops.materialize):
        out = materialize(df, name)
        rows.extend([out.count()] if name == "bounds" else [])
        return out

    monkeypatch.setattr(ops, "materialize", write)
    pairs = random_pairs(4, 40, 0.6)
    assert result(ops.truss(spark.createDataFrame(pairs, "src bigint, dst bigint"), 20)) == brute(pairs)
    assert len(rows) > 2 and max(rows) == 3
