"""Search on the diamond network and on random ones: heap, two-sided and frontier search must agree."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanegraph.operators import network, search

NODES = [(0, 601042424243945471, 0.0, 0.0, 0, 1), (1, 601041550218100735, 1.0, 1.0, 0, 1), (2, 601042110711332863, -1.0, 1.0, 0, 1), (3, 601044398855159807, 0.0, 2.0, 0, 1)]
EDGES = [(0, 0, 1, 1.0), (1, 0, 2, 2.0), (2, 1, 3, 1.0), (3, 2, 3, 1.0)]
NODE_DDL = "node_id int, h3_int long, lat float, lon float, component_id int, node_class short"
EDGE_DDL = "edge_id int, src int, dst int, cost float"


@pytest.fixture(scope="module")
def diamond(spark):
    return spark.createDataFrame(NODES, NODE_DDL), spark.createDataFrame(EDGES, EDGE_DDL)


def ask(spark, pairs, algorithm):
    return spark.createDataFrame([(i, s, t, algorithm) for i, (s, t) in enumerate(pairs)], "request_id long, from_node int, to_node int, algorithm string")


PAIRS = [(0, 3), (2, 2), (-1, 0), (0, 999), (0, 1), (3, 0)]


@pytest.mark.parametrize("way", ["dijkstra", "bidirectional-a-star", "frontier"])
def test_diamond(spark, diamond, way):
    nodes, edges = diamond
    requests = ask(spark, PAIRS, way)
    found = search.route_by_frontier(requests, nodes, edges) if way == "frontier" else search.route_requests(requests, nodes, edges)
    rows = {r["request_id"]: r for r in found.collect()}
    assert [rows[i]["status"] for i in range(6)] == ["Success", "Success", "InvalidNode", "InvalidNode", "Success", "NoPath"]
    assert rows[0]["path_nodes"] == [0, 1, 3] and rows[0]["path_edges"] == [0, 2] and rows[0]["total_cost"] == 2
    assert rows[0]["total_distance_nm"] == pytest.approx(169.815757, abs=1e-4)
    assert rows[1]["path_nodes"] == [2] and rows[1]["path_edges"] == [] and rows[1]["total_cost"] == 0
    assert rows[4]["path_nodes"] == [0, 1]


def random_csr(seed, n=60, m=240, whole=True):
    r = random.Random(seed)
    src = np.array([r.randrange(n) for _ in range(m)])
    dst = np.array([r.randrange(n) for _ in range(m)])
    cost = np.array([r.randrange(0, 20) if whole else r.random() for _ in range(m)], np.float32)
    lat = np.array([r.uniform(-70, 70) for _ in range(n)])
    lon = np.array([r.uniform(-180, 180) for _ in range(n)])
    return search.Csr(src, dst, cost, np.arange(m), n, lat, lon), src, dst, cost


def bellman_ford(n, src, dst, cost, s):
    d = [math.inf] * n
    d[s] = 0.0
    for _ in range(n):
        for a, b, c in zip(src, dst, cost):
            d[b] = min(d[b], d[a] + float(c))
    return d


@pytest.mark.parametrize("seed", range(6))
def test_two_sided_equals_heap_equals_relaxation(seed):
    csr, src, dst, cost = random_csr(seed, whole=seed % 2 == 0)
    search.add_landmarks(csr, [1, 7, 20], 0.0)
    for s in range(0, 60, 7):
        want = bellman_ford(60, src, dst, cost, s)
        for t in range(60):
            one, two = search.solve(csr, s, t, "dijkstra"), search.solve(csr, s, t, "bidirectional-a-star")
            assert one[0] == two[0] == ("Success" if want[t] < math.inf else "NoPath")
            if one[0] == "Success":
                assert one[4] == pytest.approx(want[t], rel=1e-9) and two[4] == pytest.approx(want[t], rel=1e-9, abs=1e-9)
                for nodes, edges in ((one[2], one[3]), (two[2], two[3])):
                    assert nodes[0] == s and nodes[-1] == t
                    assert [(src[e], dst[e]) for e in edges] == list(zip(nodes, nodes[1:]))
                    assert sum(float(cost[e]) for e in edges) == pytest.approx(want[t], abs=1e-6)


@pytest.mark.parametrize("seed", range(4))
def test_array_relaxation_equals_heap(seed):
    csr, *_ = random_csr(seed, whole=seed % 2 == 0)
    for s in range(0, 60, 9):
        for reverse in (False, True):
            want = np.full(60, math.inf)
            dist = search.tree(csr, s, reverse)[0]
            want[list(dist)] = list(dist.values())
            assert (search.all_distances(csr, s, reverse) == want).all()


@pytest.mark.parametrize("seed", range(3))
def test_landmark_bounds_never_exceed_distances(seed):
    csr, src, dst, cost = random_csr(seed)
    search.add_landmarks(csr, [0, 5, 9, 33], 0.0)
    for s in range(0, 60, 11):
        want = bellman_ford(60, src, dst, cost, s)
        assert all(search.lower_bound(csr, s, t) <= want[t] + 1e-9 for t in range(60))


def test_frontier_equals_heap_on_table(spark):
    csr, src, dst, cost = random_csr(3)
    nodes = spark.createDataFrame([(i, i, float(a), float(b), 0, 0) for i, (a, b) in enumerate(zip(csr.lat, csr.lon))], NODE_DDL)
    edges = spark.createDataFrame([(i, int(a), int(b), float(c)) for i, (a, b, c) in enumerate(zip(src, dst, cost))], EDGE_DDL)
    roots = spark.createDataFrame([(0,), (5,)], "source int")
    for reverse in (False, True):
        a = {(r[0], r[1]): r[2] for r in search.distances(roots, nodes, edges, reverse).collect()}
        b = {(r[0], r[1]): r[2] for r in search.distances(roots, nodes, edges, reverse, limit=0).collect()}
        assert a == b


def test_ways_agree_on_table(spark):
    """Shared trees, single searches and frontier rounds give the same costs, and the first and last the same count of settled nodes."""
    csr, src, dst, cost = random_csr(8, whole=False)
    nodes = spark.createDataFrame([(i, i, float(a), float(b), 0, 0) for i, (a, b) in enumerate(zip(csr.lat, csr.lon))], NODE_DDL)
    edges = spark.createDataFrame([(i, int(a), int(b), float(c)) for i, (a, b, c) in enumerate(zip(src, dst, cost))], EDGE_DDL)
    pairs = [(s, t) for s in (0, 5, 11) for t in range(0, 60, 4)] + [(59, 2), (3, 3), (70, 1)]
    batch = {r["request_id"]: r for r in search.route_requests(ask(spark, pairs, "dijkstra"), nodes, edges).collect()}
    rounds = {r["request_id"]: r for r in search.route_by_frontier(ask(spark, pairs, "dijkstra"), nodes, edges).collect()}
    for i, (s, t) in enumerate(pairs):
        one = search.solve(csr, s, t, "dijkstra")
        for found in (batch[i], rounds[i]):
            assert found["status"] == one[0] and found["visited"] == one[6]
            assert (found["path_nodes"], found["path_edges"]) == (one[2], one[3])
            assert one[4] is None or found["total_cost"] == pytest.approx(one[4])


def test_long_chain_by_doubling(spark):
    n = 70
    nodes = spark.createDataFrame([(i, i, 0.0, i / 10, 0, 0) for i in range(n)], NODE_DDL)
    edges = spark.createDataFrame([(i, i, i + 1, 1.0) for i in range(n - 1)], EDGE_DDL)
    reach = spark.createDataFrame([(0, i, float(i), i - 1, i - 1) for i in range(n)], "source int, node_id int, distance double, last_edge int, before int")
    got = {r["request_id"]: r for r in search.trails(spark.createDataFrame([(1, 0, 69), (2, 0, 0), (3, 0, 33)], "request_id long, source int, node_id int"), reach).collect()}
    assert got[1]["nodes"] == list(range(70)) and got[1]["edges"] == list(range(69))
    assert got[2]["nodes"] == [0] and got[2]["edges"] == [] and got[3]["nodes"] == list(range(34))


def test_two_sided_visits_less():
    """On a wide grid with landmarks far fewer nodes are settled than by Dijkstra."""
    side = 40
    at = lambda x, y: x * side + y
    legs = [(at(x, y), at(x + a, y + b)) for x in range(side) for y in range(side) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= x + a < side and 0 <= y + b < side]
    r = random.Random(1)
    src, dst = np.array([a for a, _ in legs]), np.array([b for _, b in legs])
    cost = np.array([1 + r.random() / 4 for _ in legs], np.float32)
    csr = search.Csr(src, dst, cost, np.arange(len(legs)), side * side, np.zeros(side * side), np.zeros(side * side))
    search.add_landmarks(csr, [at(0, 0), at(0, side - 1), at(side - 1, 0), at(side - 1, side - 1)], 0.0)
    pairs = [(at(3, 3), at(36, 30)), (at(20, 5), at(22, 35)), (at(39, 0), at(1, 38))]
    one, two = ([search.solve(csr, s, t, how) for s, t in pairs] for how in ("dijkstra", "bidirectional-a-star"))
    assert [x[4] for x in one] == pytest.approx([x[4] for x in two])
    assert sum(x[6] for x in two) < 0.5 * sum(x[6] for x in one)
    assert all(x[6] == x[7] + x[8] for x in two)


def test_landmarks_and_components(spark):
    rows = [(0, 1, 5.0, 3.0, 0, 0), (1, 2, 1.0, -9.0, 1, 0), (2, 3, 9.0, 9.0, 1, 0), (3, 4, -2.0, 0.0, 0, 0), (4, 5, 50.0, 50.0, -1, 0)]
    nodes = spark.createDataFrame(rows, NODE_DDL)
    stats = {r["component_id"]: r for r in network.component_stats(nodes).collect()}
    assert stats[0]["dominant"] and not stats[1]["dominant"] and -1 not in stats
    assert network.landmark_component(nodes).first()[0] == 1  # reaches the size first
    assert [r["node_id"] for r in network.landmarks(nodes).orderBy("place").collect()] == [1, 2]


def test_parallel_edges_first_and_cheapest(spark, diamond):
    nodes, _ = diamond
    edges = spark.createDataFrame([(0, 0, 1, 5.0), (1, 0, 1, 2.0), (2, 1, 3, 0.0)], EDGE_DDL)
    row = search.route_requests(ask(spark, [(0, 3)], "dijkstra"), nodes, edges).first()
    assert row["total_cost"] == 2 and row["path_edges"] == [1, 2]
    assert network.first_edges(edges).where("src = 0").first()["edge_id"] == 0


def test_min_rate_skips_free_edges(spark, diamond):
    nodes, _ = diamond
    edges = spark.createDataFrame([(0, 0, 0, 1.0), (1, 0, 1, 0.0)], EDGE_DDL)
    assert network.min_cost_rate(edges, nodes).first()[0] == 0.0


def test_overflow_targets(spark):
    coded = spark.createDataFrame([(0, 0, 1), (1, 0, network.DELTA_OVERFLOW)], "edge_id int, src int, delta int")
    good = spark.createDataFrame([(1, 90000)], "position int, target int")
    assert sorted(tuple(r) for r in network.decode_targets(coded, good).collect()) == [(0, 0, 1), (1, 0, 90000)]
    for bad in ([(0, 5), (1, 7)], [(9, 5)]):
        with pytest.raises(Exception, match="overflow"):
            network.decode_targets(coded, spark.createDataFrame(bad, "position int, target int")).collect()


def test_empty_requests(spark, diamond):
    nodes, edges = diamond
    assert search.route_requests(ask(spark, [(0, 1)], "dijkstra").where(F.lit(False)), nodes, edges).count() == 0


def test_blocks_of_sources_expand_like_the_join(spark, monkeypatch):
    """Costs of many sources over one more edge: the same as by the join, with repeated edges and nodes of several blocks and strips, and no way is shuffled."""
    r = random.Random(3)
    edges = spark.createDataFrame([(i, r.randrange(40), r.randrange(40), float(r.randrange(9))) for i in range(500)], EDGE_DDL)
    front = edges.selectExpr("src AS source", "dst AS at", "cast(cost AS double) AS so_far")
    want = search.expand(front, edges).selectExpr("source", "node_id", "new.distance")
    got = search.expand_costs(front, edges, 7).cache()
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    import pyarrow as pa

    left, right = pa.table({"source": [3, 4, 5], "at": [1, 1, 2], "so_far": [1.0, 2.0, 0.0]}), pa.table({"at": [1, 2, 2], "node_id": [8, 8, 9], "cost": [1.0, 5.0, 6.0]})
    monkeypatch.setattr(search, "STRIP_CELLS", 2)
    rows = [x for b in search._block_costs(left, right) for x in zip(*b.to_pydict().values())]
    assert rows == [(3, 8, 2.0), (4, 8, 3.0), (5, 8, 5.0), (5, 9, 6.0)]
