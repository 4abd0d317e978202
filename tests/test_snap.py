"""The grid join finds exactly what brute force finds, at the date line and the poles too."""

import random

import pytest
from pyspark.sql import functions as F

from lanegraph.functions.geo import haversine_py
from lanegraph.operators import snap


def frame(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} int, lat double, lon double")


@pytest.mark.parametrize("radius", [5.0, 100.0, 700.0, 3000.0, 20000.0])
def test_against_brute_force(spark, radius):
    r = random.Random(int(radius))
    spots = [(89.9, 10.0), (-89.9, 0.0), (90.0, 0.0), (0.0, 180.0), (0.0, -180.0), (0.0, 179.99), (10.0, -179.99), (0.0, 0.0), (60.0, 359.0 - 180.0)]
    near = [(a + r.uniform(-1, 1), b + r.uniform(-1, 1)) for a, b in spots for _ in range(6)]
    near = [(max(-90.0, min(90.0, a)), (b + 180.0) % 360.0 - 180.0) for a, b in near]
    points = near + [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(120)]
    nodes = frame(spark, [(i, *p) for i, p in enumerate(points)], "node_id").selectExpr("*", "node_id % 3 - 1 AS component_id")
    asked = spots + [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(25)]
    queries = frame(spark, [(i, *p) for i, p in enumerate(asked)], "query_id")
    rows = [(x["query_id"], x["node_id"]) for x in snap.within_radius(queries, nodes, radius).collect()]
    want = {(i, j) for i, q in enumerate(asked) for j, p in enumerate(points) if haversine_py(*q, *p) <= radius}
    assert len(rows) == len(set(rows))
    edge = {(i, j) for i, j in want ^ set(rows) if abs(haversine_py(*asked[i], *points[j]) - radius) > 1e-6}
    assert not edge


def test_ranking_and_fallbacks(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0, -1), (1, 1.0, 1.0, 0), (2, -1.0, 1.0, 0), (3, 0.0, 2.0, 0)], "node_id int, lat double, lon double, component_id int")
    ask = frame(spark, [(0, 0.0, 0.0), (1, 50.0, 50.0)], "query_id")
    got = snap.nearest(ask, nodes, 2, 500.0).orderBy("rank").collect()
    assert [g["node_id"] for g in got] == [0, 1] and got[0]["distance_nm"] == 0
    assert [g["node_id"] for g in snap.nearest(ask, nodes, 1, 500.0, component=0).collect()] == [1]
    assert {(r[0], r[1]) for r in snap.snap_coordinates(ask, nodes, 500.0).collect()} == {(0, 1), (1, -1)}
    assert {(r[0], r[1]) for r in snap.snap_coordinates(ask, nodes, 1.0).collect()} == {(0, 0), (1, -1)}


def test_stream(spark, tmp_path):
    from lanegraph.streaming.snap_stream import snap_stream

    nodes = spark.createDataFrame([(0, 0.0, 0.0, 0), (1, 5.0, 5.0, 0)], "node_id int, lat double, lon double, component_id int")
    frame(spark, [(7, 0.1, 0.1), (8, 60.0, 60.0)], "query_id").write.json(str(tmp_path / "in"))
    live = spark.readStream.schema("query_id int, lat double, lon double").json(str(tmp_path / "in"))
    q = snap_stream(live, nodes, 60.0).writeStream.format("memory").queryName("snapped").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["query_id"], r["node_id"]) for r in spark.table("snapped").collect()] == [(7, 0)]


def test_nearest_meets_few_of_the_nodes_within_the_radius(spark):
    """400 queries have up to 4,000 nodes within 3,000 miles each; the join must not make them all, and the result is brute force's."""
    r = random.Random(7)
    points = [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(2500)] + [(20 + r.gauss(0, 0.2), 179.9 + r.gauss(0, 0.2)) for _ in range(1500)]
    nodes = frame(spark, [(i, max(-90.0, min(90.0, a)), (b + 180.0) % 360.0 - 180.0) for i, (a, b) in enumerate(points)], "node_id").selectExpr("*", "node_id % 3 - 1 AS component_id").cache()
    asked = points[::10] + [(89.99, 5.0), (-90.0, 0.0), (20.0, 180.0), (20.0, -180.0)]
    queries = frame(spark, [(i, max(-90.0, min(90.0, a)), b) for i, (a, b) in enumerate(asked)], "query_id")
    for k, radius, component in ((5, 3000.0, None), (2, 3000.0, 1), (5, 100.0, None), (7, 20000.0, None)):
        rows = snap.nearest(queries, nodes, k, radius, component).collect()
        got = {}
        for x in sorted(rows, key=lambda x: (x["query_id"], x["rank"])):
            got.setdefault(x["query_id"], []).append(x["node_id"])
        held = [(n["node_id"], n["lat"], n["lon"]) for n in nodes.collect() if component is None or n["component_id"] == component]
        for q in queries.collect():
            want = sorted((haversine_py(q["lat"], q["lon"], a, b), i) for i, a, b in held)[:k]
            assert got.get(q["query_id"], []) == [i for d, i in want if d <= radius]
    reaches = snap._reaches(queries, nodes, 5, 3000.0).withColumn("size", F.lit(0))
    assert snap._near(reaches, nodes, [3000.0]).count() < 60 * len(asked)
    twice = queries.limit(1).unionByName(queries.limit(1))
    assert snap.nearest(twice, nodes, 4, 3000.0).count() == 4
