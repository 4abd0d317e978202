"""Goal-directed search by joins against the heap searches, and how few nodes it takes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanegraph.operators import frontier, network, search
from tests.test_search import EDGE_DDL, NODE_DDL, ask, random_csr


def tables(spark, csr, src, dst, cost, n):
    nodes = spark.createDataFrame([(i, i, float(a), float(b), 0, 0) for i, (a, b) in enumerate(zip(csr.lat, csr.lon))], NODE_DDL)
    return nodes, spark.createDataFrame([(i, int(a), int(b), float(c)) for i, (a, b, c) in enumerate(zip(src, dst, cost))], EDGE_DDL)


@pytest.mark.parametrize("seed,whole", [(2, True), (5, False)])
def test_both_algorithms_equal_the_heap(spark, monkeypatch, seed, whole):
    monkeypatch.setattr(frontier, "MERGE", 3)
    csr, src, dst, cost = random_csr(seed, whole=whole)
    nodes, edges = tables(spark, csr, src, dst, cost, 60)
    pairs = [(s, t) for s in (0, 13, 40) for t in range(0, 60, 5)] + [(3, 3), (70, 1), (1, -4)]
    asked = [(2 * i + k, s, t, a) for i, (s, t) in enumerate(pairs) for k, a in enumerate(("dijkstra", "bidirectional-a-star"))]
    requests = spark.createDataFrame(asked, "request_id long, from_node int, to_node int, algorithm string")
    rows = {r["request_id"]: r for r in search.route_by_frontier(requests, nodes, edges, search.landmark_table(nodes, edges)).collect()}
    assert len(rows) == len(asked)
    for i, s, t, algorithm in asked:
        want, got = search.solve(csr, s, t, "dijkstra"), rows[i]
        assert got["status"] == want[0] and got["failure_reason"] == want[1]
        if want[0] != "Success":
            continue
        assert got["total_cost"] == pytest.approx(want[4], rel=1e-9, abs=1e-9)
        assert got["path_nodes"][0] == s and got["path_nodes"][-1] == t
        assert [(src[e], dst[e]) for e in got["path_edges"]] == list(zip(got["path_nodes"], got["path_nodes"][1:]))
        assert sum(float(cost[e]) for e in got["path_edges"]) == pytest.approx(want[4], abs=1e-6)
        if algorithm == "dijkstra":
            assert got["fwd_visited"] is None and (whole or got["visited"] == want[6])
        elif s != t:
            assert got["visited"] == got["fwd_visited"] + got["rev_visited"] > 0


def grid(spark, side=14):
    at = lambda x, y: x * side + y
    legs = [(at(x, y), at(x + a, y + b)) for x in range(side) for y in range(side) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= x + a < side and 0 <= y + b < side]
    r = random.Random(1)
    cost = [1 + r.randrange(8) / 32 for _ in legs]
    nodes = spark.createDataFrame([(at(x, y), at(x, y), float(x), float(y), 0, 0) for x in range(side) for y in range(side)], NODE_DDL)
    edges = spark.createDataFrame([(i, a, b, c) for i, ((a, b), c) in enumerate(zip(legs, cost))], EDGE_DDL)
    csr = search.Csr(np.array([a for a, _ in legs]), np.array([b for _, b in legs]), np.array(cost, np.float32), np.arange(len(legs)), side * side, np.zeros(side * side), np.zeros(side * side))
    return nodes, edges, csr, at


def test_far_fewer_nodes_are_settled_than_by_the_tree(spark):
    """Trees stop at their farthest target; two sides with landmarks keep to the way between the ends."""
    nodes, edges, csr, at = grid(spark)
    pairs = [(at(4, 4), at(5, 8)), (at(9, 2), at(10, 6))]
    one, two = ({r["request_id"]: r for r in search.route_by_frontier(ask(spark, pairs, how), nodes, edges, search.landmark_table(nodes, edges)).collect()} for how in ("dijkstra", "bidirectional-a-star"))
    for i, (s, t) in enumerate(pairs):
        want = search.solve(csr, s, t, "dijkstra")
        assert one[i]["total_cost"] == pytest.approx(want[4]) and two[i]["total_cost"] == pytest.approx(want[4])
        assert one[i]["visited"] == want[6] < 0.5 * 14 * 14
        assert two[i]["visited"] < 0.6 * one[i]["visited"]
    units = spark.createDataFrame([(1, at(4, 4), None)], "unit long, s int, t int")
    labels, _ = frontier.grow(units, spark.createDataFrame([(1, at(4, 6))], "unit long, node int"), edges, None, 1.0)
    assert labels.count() < 50  # not the tree of 196 nodes


def test_no_requests_and_no_edges(spark):
    nodes, edges, _, at = grid(spark, 3)
    assert search.route_by_frontier(ask(spark, [(0, 1)], "dijkstra").where(F.lit(False)), nodes, edges).count() == 0
    rows = search.route_by_frontier(ask(spark, [(0, 1), (2, 2)], "bidirectional-a-star"), nodes, edges.where(F.lit(False))).collect()
    assert sorted((r["request_id"], r["status"], r["visited"]) for r in rows) == [(0, "NoPath", 0), (1, "Success", 0)]


def test_rounds_read_the_edges_in_place(spark):
    """A join with the adjacency shuffles only its other side, and all edges are in it; pieces of a large node are separate rows."""
    edges = spark.range(9000).selectExpr("cast(id as int) edge_id", "cast(if(id < 8500, 1, id % 50) as int) src", "cast(id % 97 as int) dst", "cast(id % 5 as float) cost")
    for reverse in (False, True):
        kept = network.adjacency(edges, reverse)
        plan = spark.range(5).selectExpr("cast(id as int) at").hint("merge").join(kept, "at")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
        flat = kept.select("at", F.explode("steps").alias("x")).select(F.col("x.edge").alias("edge_id"), "at", "x.node", "x.cost")
        want = edges.selectExpr("edge_id", *(("dst", "src") if reverse else ("src", "dst")), "cast(cost as double)")
        assert flat.count() == 9000 and flat.exceptAll(want).count() == 0
        assert kept.agg(F.max(F.size("steps"))).first()[0] <= network.PIECE


def test_pairs_that_nothing_links(spark, monkeypatch):
    """Ends in different groups of linked nodes get no search at all."""
    links = [(i, i + 1) for i in range(0, 20)] + [(41, 40), (42, 41), (50, 50)]
    edges = spark.createDataFrame([(i, a, b, 1.0) for i, (a, b) in enumerate(links)], EDGE_DDL)
    found = {r["node"]: r["group"] for r in network.linked_groups(edges).collect()}
    assert found == {**dict.fromkeys(range(21), 0), 40: 40, 41: 40, 42: 40}
    nodes = spark.createDataFrame([(i, i, 0.0, float(i), 0, 0) for i in range(60)], NODE_DDL)
    asked = []
    monkeypatch.setattr(frontier, "grow", lambda units, *rest, grow=frontier.grow: asked.append(units.count()) or grow(units, *rest))
    rows = search.route_by_frontier(ask(spark, [(0, 41), (50, 3), (58, 59)], "bidirectional-a-star"), nodes, edges, search.landmark_table(nodes, edges)).collect()
    assert {(r["status"], r["visited"]) for r in rows} == {("NoPath", 0)} and asked == [0]


@pytest.mark.parametrize("limit,joins", [(1 << 20, False), (100, True), (0, True)])
def test_small_groups_are_searched_in_tasks(spark, monkeypatch, limit, joins):
    """Three networks without links to each other, of which the limit lets all, the small ones or none be searched whole; no joins by rounds where all are."""
    made = [random_csr(seed, n=n, m=m)[1:] for seed, n, m in ((2, 60, 240), (5, 20, 60), (7, 20, 60))]
    shift = np.cumsum([0, 60, 20])
    src, dst, cost = (np.concatenate([x[i] + (k if i < 2 else 0) for x, k in zip(made, shift)]) for i in range(3))
    r = np.random.default_rng(3)
    csr = search.Csr(src, dst, cost, np.arange(len(src)), 101, r.uniform(-60, 60, 101), r.uniform(-170, 170, 101))
    nodes, edges = tables(spark, csr, src, dst, cost, 101)
    if not joins:
        monkeypatch.setattr(frontier, "adjacency", None)
    monkeypatch.setattr(search, "TASK_REQUESTS", 7)
    pairs = [(s, t) for s in (0, 13, 61, 62, 85, 100) for t in range(0, 101, 9)] + [(3, 3), (200, 1), (1, -4), (None, 2)]
    asked = [(2 * i + k, s, t, a) for i, (s, t) in enumerate(pairs) for k, a in enumerate(("dijkstra", "bidirectional-a-star")) if joins or s != 100 or k]
    requests = spark.createDataFrame(asked, "request_id long, from_node int, to_node int, algorithm string")
    rows = search.route_by_groups(requests, nodes, edges, limit).collect()
    assert sorted(x["request_id"] for x in rows) == sorted(a[0] for a in asked)
    want = {i: search.solve(csr, s, t, a) for i, s, t, a in asked}
    for x in rows:
        status, why, walk, steps, total, nm, visited = want[x["request_id"]][:7]
        assert (x["status"], x["failure_reason"]) == (status, why)
        if status != "Success":
            continue
        assert x["total_cost"] == pytest.approx(total, rel=1e-9, abs=1e-9)
        assert [(src[e], dst[e]) for e in x["path_edges"]] == list(zip(x["path_nodes"], x["path_nodes"][1:]))
        assert (x["path_nodes"][0], x["path_nodes"][-1]) == (walk[0], walk[-1])


def test_distances_in_small_groups(spark, monkeypatch):
    """Landmark tables beyond the broadcast bound: no rounds of joins where the sources' groups are small."""
    csr, src, dst, cost = random_csr(2, whole=False)
    nodes, edges = tables(spark, csr, src, dst, cost, 60)
    monkeypatch.setattr(search, "frontier_distances", None)
    want, got = ({(r["landmark"], r["node_id"]): (r["from_landmark"], r["to_landmark"]) for r in search.landmark_table(nodes, edges, limit).collect()} for limit in (1 << 20, 0))
    assert len(want) and got == want


def test_forests_keep_the_groups():
    r = np.random.default_rng(4)
    a, b = r.integers(0, 400, 300), r.integers(0, 400, 300)
    least = {v: v for v in range(400)}
    for _ in range(400):
        for x, y in zip(a.tolist(), b.tolist()):
            least[x] = least[y] = min(least[x], least[y])
    made = network._forest(a, b).to_pydict()
    assert dict(zip(made["a"], made["b"])) == {v: m for v, m in least.items() if v != m}
