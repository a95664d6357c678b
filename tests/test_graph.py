import random

import numpy as np
import pytest

from sylvan.functions import weights
from sylvan.operators.components import connected_components
from sylvan.operators.graph import canonical_edges, dense_index, is_forest, offsets
from sylvan.operators.msf import block_spanning_forest, minimum_spanning_forest
from sylvan.operators.triangles import edge_support, triangles, truss
from sylvan.runtime import join_per_key
from sylvan.sources import graph_files

EDGES = "src bigint, dst bigint, w bigint"


def random_graph(seed, n=30, m=90, top=5):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n), r.randint(-top, top)) for _ in range(m)]


def least(edges):
    out = {}
    for a, b, w in edges:
        if a != b:
            k = (min(a, b), max(a, b))
            out[k] = min(w, out.get(k, w))
    return out


def kruskal(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    out = []
    for (a, b), w in sorted(pairs.items(), key=lambda i: (i[1], i[0])):
        if find(a) != find(b):
            up[find(a)] = find(b)
            out.append((a, b, w))
    return sorted(out)


def test_canonical(spark):
    edges = random_graph(1) + [(4, 4, 1)]
    got = canonical_edges(spark.createDataFrame(edges, EDGES)).collect()
    assert {(r.src, r.dst): r.w for r in got} == least(edges)
    for bad in ([(1, None, 2)], [(1, 2, None)]):
        with pytest.raises(Exception, match="null"):
            canonical_edges(spark.createDataFrame(bad, EDGES)).collect()
    with pytest.raises(Exception, match="NaN"):
        canonical_edges(spark.createDataFrame([(1, 2, float("nan"))], "src bigint, dst bigint, w double")).collect()
    with pytest.raises(Exception, match="loop"):
        canonical_edges(spark.createDataFrame([(1, 1, 2)], EDGES), loops="error").collect()


@pytest.mark.parametrize("limit", [10, 10**6])
def test_components(spark, limit):
    edges = random_graph(2, 120, 90)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, EDGES), one_task=limit).collect()}
    pairs, want = least(edges), {}
    for v in {x for p in pairs for x in p}:
        seen, todo = {v}, [v]
        while todo:
            x = todo.pop()
            for p in pairs:
                if x in p and (y := p[0] + p[1] - x) not in seen:
                    seen.add(y)
                    todo.append(y)
        want[v] = min(seen)
    assert got == want
    assert connected_components(spark.createDataFrame([], EDGES)).collect() == []


@pytest.mark.parametrize("limit", [20, 10**6])
def test_spanning_forest(spark, limit):
    edges = random_graph(3, 60, 200)
    df = canonical_edges(spark.createDataFrame(edges, EDGES)).repartition(8)
    got = minimum_spanning_forest(df, limit)
    assert sorted(map(tuple, got.collect())) == kruskal(least(edges))
    assert is_forest(got) and not is_forest(df)


def test_spanning_forest_of_points(spark):
    r = random.Random(4)
    points = [(i, [r.randint(-50, 50) for _ in range(3)]) for i in range(90)]
    x = np.array([p for _, p in points])
    pairs = {(i, j): int(((x[i] - x[j]) ** 2).sum()) for i in range(90) for j in range(i + 1, 90)}
    got = block_spanning_forest(spark.createDataFrame(points, "id bigint, vector array<bigint>"), 25)
    assert sorted(map(tuple, got.collect())) == kruskal(pairs)


def brute_truss(pairs):
    left, out, k = set(pairs), {}, 0
    near = lambda p: [v for v in {x for e in left for x in e} if tuple(sorted((p[0], v))) in left and tuple(sorted((p[1], v))) in left]
    while left:
        low = {p: len(near(p)) for p in left}
        k = max(k, min(low.values()))
        gone = [p for p in left if low[p] <= k]
        for p in gone:
            out[p] = k
        left -= set(gone)
    return out


@pytest.mark.parametrize("limit", [5, 10**6])
def test_triangles_and_truss(spark, limit):
    pairs = least(random_graph(6, 14, 60))
    df = spark.createDataFrame([(*p, 1) for p in pairs], EDGES)
    want = {(a, b, c) for a, b in pairs for c in range(14) if b < c and (a, c) in pairs and (b, c) in pairs}
    assert {tuple(r) for r in triangles(df).collect()} == want
    support = {(r.src, r.dst): r.support for r in edge_support(df).collect()}
    assert support == {p: sum(set(p) <= set(t) for t in want) for p in pairs}
    got = truss(df, limit).collect()
    assert {(r.src, r.dst): r.k for r in got} == brute_truss(pairs)


def test_weights(spark):
    df = spark.createDataFrame([(0, 1, 1), (0, 2, 1), (1, 2, 1), (2, 3, 1), (2, 4, 1), (3, 4, 1)], EDGES)
    kept = {(r.lo, r.hi): r.shared for r in weights.top_triangles(df).collect()}
    assert kept == {(0, 1): 1, (0, 2): 0, (1, 2): 0, (3, 4): 1, (3, 2): 0, (4, 2): 0}
    assert sorted(r.w for r in weights.permutation(df).collect()) == [1, 2, 3, 4, 5, 6]
    assert {(r.src, r.dst): r.w for r in weights.inverse_degree(df).collect()}[2, 3] == pytest.approx(1 / 6)
    assert [r.w for r in weights.low_parallelism(df).orderBy("src", "dst").collect()] == [0, 1, 2, 5, 4, 3]
    assert {r.w for r in weights.inverse_triangles(df).collect()} == {1.0}


def test_numbering_of_ranges(spark, monkeypatch):
    from sylvan.operators import graph

    monkeypatch.setattr(graph, "ONE_TASK_ROWS", 50)
    df = spark.range(500).selectExpr("(id * 7919) % 1009 AS k")
    got = dense_index(df, ["k"], "i").orderBy("k").collect()
    assert [r.i for r in got] == list(range(500))
    edges = spark.createDataFrame([(a, b, 1) for a, b in least(random_graph(7, 80, 200))], EDGES)
    rows = offsets(edges).orderBy("id").collect()
    assert [r.offset for r in rows] == [sum(x.degree for x in rows[:i]) for i in range(len(rows))]


@pytest.mark.parametrize("weight", ["int", None])
def test_adjacency_round_trip(spark, tmp_path, weight):
    pairs = least(random_graph(8, 20, 40))
    rows = [(a, b, w) if weight else (a, b) for (a, b), w in pairs.items()]
    df = spark.createDataFrame(rows, EDGES if weight else "src bigint, dst bigint")
    graph_files.write_adjacency(df, f"{tmp_path}/g")
    got = graph_files.read_graph(spark, f"{tmp_path}/g", "adjacency", weight)
    assert sorted(map(tuple, got.collect())) == sorted(rows)


def test_adjacency_in_splits(spark, tmp_path):
    lines = ["WeightedAdjacencyGraph", "4", "6", "0", "2", "3", "5", "1", "2", "0", "0", "3", "2", "5", "6", "5", "6", "7", "7"]
    (tmp_path / "g.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "11")
    try:
        got = graph_files.read_adjacency(spark, f"{tmp_path}/g.txt", "int")
        assert sorted(map(tuple, got.collect())) == [(0, 1, 5), (0, 2, 6), (2, 3, 7)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(ValueError):
        graph_files.read_graph(spark, f"{tmp_path}/g.txt", "other")


def test_adjacency_with_vertices_without_edges(spark, tmp_path):
    """Also beyond 2^20 vertices, and as a folder of several files."""
    rows = [(0, 1, 5), (4, (1 << 20) + 9, 7), (6, 9, -2)]
    graph_files.write_adjacency(spark.createDataFrame(rows, EDGES), f"{tmp_path}/g")
    assert sorted(map(tuple, graph_files.read_adjacency(spark, f"{tmp_path}/g", "int").collect())) == rows
    lines = [r.value for r in spark.read.text(f"{tmp_path}/g").collect()]
    assert len(lines) == 3 + (1 << 20) + 10 + 12 and lines[3:14] == ["0", "1", "2", "2", "2", "3", "3", "4", "4", "4", "5"]
    (tmp_path / "parts").mkdir()
    for k, start in enumerate(range(0, len(lines), 300_000)):
        (tmp_path / "parts" / f"part-{k:05d}.txt").write_text("\n".join(lines[start : start + 300_000]) + "\n")
    assert sorted(map(tuple, graph_files.read_adjacency(spark, f"{tmp_path}/parts", "int").collect())) == rows


def test_binary_is_found_as_written(spark, tmp_path):
    rows = [(0, 1, 5), (1, 7, 6)]
    graph_files.write_binary(spark.createDataFrame(rows, EDGES), f"{tmp_path}/b")
    assert sorted(map(tuple, graph_files.read_graph(spark, f"{tmp_path}/b", "binary").collect())) == rows


@pytest.mark.parametrize("weight", ["int", "float"])
def test_binary_in_many_slabs_and_pieces(spark, tmp_path, monkeypatch, weight):
    """Offsets and records over several slabs; the raw file has the bytes that its layout asks for."""
    monkeypatch.setattr(graph_files, "SLAB", 7)
    rows = sorted((a, b, w) for (a, b), w in least(random_graph(10, 24, 40)).items() if a != 3 and b != 3) + [(2, 30, -4)]
    graph_files.write_binary(spark.createDataFrame(rows, EDGES), f"{tmp_path}/b", weight)
    graph_files.save_binary(spark, f"{tmp_path}/b", f"{tmp_path}/raw.bin")
    entries = sorted((a, b, w) for x, y, w in rows for a, b in ((x, y), (y, x)))
    offs = [sum(a < v for a, _, _ in entries) for v in range(32)]
    head = np.array([31, len(entries), 24 + 8 * 32 + 8 * len(entries), *offs], "<i8").tobytes()
    records = np.array([(b, w) for _, b, w in entries], [("v", "<u4"), ("w", "<i4" if weight == "int" else "<f4")]).tobytes()
    assert (tmp_path / "raw.bin").read_bytes() == head + records
    for name in ("b", "raw.bin"):
        assert sorted(map(tuple, graph_files.read_binary(spark, f"{tmp_path}/{name}", weight).collect())) == sorted(rows)


def test_graphs_without_edges(spark, tmp_path):
    none = spark.createDataFrame([], EDGES)
    graph_files.write_binary(none, f"{tmp_path}/b")
    graph_files.write_adjacency(none, f"{tmp_path}/a")
    assert graph_files.read_binary(spark, f"{tmp_path}/b").collect() == []
    assert graph_files.read_adjacency(spark, f"{tmp_path}/a", "int").collect() == []


def test_edge_list_and_binary(spark, tmp_path):
    pairs = least(random_graph(9, 20, 40))
    rows = sorted((a, b, w) for (a, b), w in pairs.items())
    df = spark.createDataFrame(rows, EDGES)
    graph_files.write_edge_list(df, f"{tmp_path}/e")
    assert sorted(map(tuple, graph_files.read_edge_list(spark, f"{tmp_path}/e", "int").collect())) == rows
    graph_files.write_binary(df, f"{tmp_path}/b")
    assert sorted(map(tuple, graph_files.read_binary(spark, f"{tmp_path}/b").collect())) == rows
    slabs = {r.slab: bytes(r.data) for r in spark.read.parquet(f"{tmp_path}/b").collect()}
    (tmp_path / "raw.bin").write_bytes(b"".join(slabs[k] for k in sorted(slabs)))
    assert sorted(map(tuple, graph_files.read_graph(spark, f"{tmp_path}/raw.bin", "binary").collect())) == rows


def test_hot_key_join(spark):
    rows = spark.range(6000).selectExpr("id", "if(id % 3 = 0, 0, id) AS k")
    per_key = rows.groupBy("k").count().withColumnRenamed("count", "n")
    out = join_per_key(rows, per_key, ["k"], "n", 6000, ["id"])
    assert out.count() == 6000 and out.where("k = 0 and n = 2000").count() == 2000
