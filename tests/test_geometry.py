"""Masks, line of sight, string pulling, hints and stitching on the four-node chain."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanegraph import schemas
from lanegraph.operators import geometry as g
from lanegraph.operators import hints, search
from lanegraph.operators.raster import Raster
from lanegraph.plans.service import RouteService

CHAIN = {0: (0.0, 0.0), 1: (0.01, 0.005), 2: (0.02, -0.005), 3: (0.03, 0.0)}
POINTS = [CHAIN[i] for i in range(4)]
STRAIGHT = [(i, x, -0.02, x, 0.02) for i, x in enumerate((0.005, 0.015, 0.025))]
NODE_DDL = "node_id int, h3_int long, lat double, lon double, component_id int, node_class short"
EDGE_DDL = "edge_id int, src int, dst int, cost float"
HINT_DDL = "corridor_id long, locode string, kind short, flags short, confidence double, spans array<struct<src:int,dst:int>>, coords array<struct<lon:double,lat:double>>"


def mask(*land):
    rows, cols = (np.array([c[i] for c in land], int) for i in (0, 1)) if land else (np.array([], int), np.array([], int))
    return Raster.from_cells(8, 5, 1000.0, -1000.0, -2500.0, 7000.0, 2500.0, rows, cols)


def shaped(mode, gates=None, found=(), raster=None, points=POINTS):
    return g.shape_all([g.shape(mode, points, gates, list(found), True)], raster or mask())[0]


def test_mask_predicate():
    assert mask().safe((0, 0), (0.03, 0))
    assert not mask((2, 3)).safe((0, 0), (0.03, 0))
    assert not mask().safe((-10, 0), (0.03, 0))
    assert not mask().safe((-179, 0), (179, 0))
    assert mask((0, 0)).land(0, 0) and not mask((0, 0)).land(0, 1) and mask().land(-1, 0) and mask().land(5, 0)


class Flat(Raster):
    """A mask in kilometres without a projection."""

    def project(self, x, y):
        return x * 1000.0, y * 1000.0


@pytest.mark.parametrize("tiled", [False, True])
def test_walk_of_many_equals_cells_of_each(tiled):
    """Segments side by side against the cells that each touches, with packed bits and with tiles."""
    r = np.random.default_rng(5)
    grid = (r.random((40, 50)) < 0.06).astype(np.uint8)
    if tiled:
        cut = {i * 4 + j: grid[i * 16 : i * 16 + 16, j * 16 : j * 16 + 16] for i in range(3) for j in range(4)}
        raster = Raster(50, 40, 1000.0, 0.0, 0.0, 50000.0, 40000.0, tile=(16, 16), tiles={k: b"" if not v.any() else zlib.compress(np.packbits(v).tobytes()) for k, v in cut.items()}, codec=1)
    else:
        raster = Raster(50, 40, 1000.0, 0.0, 0.0, 50000.0, 40000.0, bits=np.packbits(grid).tobytes())
    deg = 111319.49079327357
    a, b = (np.stack([r.uniform(-500, 50500, 600), r.uniform(-500, 40500, 600)], 1) / deg for _ in range(2))
    a[:20], b[:20] = np.round(a[:20] * deg, -3) / deg, np.round(b[:20] * deg, -3) / deg
    want = [all(c is not None and 0 <= c[0] < 40 and 0 <= c[1] < 50 and not grid[c] for c in raster.touched(tuple(p), tuple(q))) for p, q in zip(a, b)]
    assert raster.safe_many(a, b).tolist() == want and 20 < sum(want) < 500


def flat(*land):
    grid = np.zeros(16, np.uint8)
    for row, col in land:
        grid[row * 4 + col] = 1
    return Flat(4, 4, 1000.0, 0.0, 0.0, 4000.0, 4000.0, bits=np.packbits(grid).tobytes())


def test_corner_needs_both_sides():
    assert list(flat().touched((0.5, 0.5), (1.5, 1.5))) == [(3, 0), (3, 1), (2, 0), (2, 1)]
    for land, ok in (((3, 1), False), ((2, 0), False), ((2, 1), False), ((1, 1), True)):
        assert flat(land).safe((0.5, 0.5), (1.5, 1.5)) is ok


def test_modes():
    out = shaped("shortcut")
    assert out["points"] == [CHAIN[0], CHAIN[3]] and out["used"] == "shortcut"
    assert shaped("funnel") | {"points": 0} == {"requested": "funnel", "used": "shortcut", "raw_count": 4, "funnel_count": None, "fallback_count": 0, "shaped_count": 0, "sections": [], "points": 0, "final_count": 2}
    assert g.shape_all([g.shape("funnel", POINTS, None, [], False)], None)[0]["used"] == "raw"
    out = shaped("funnel", STRAIGHT)
    assert len(out["points"]) == 2 and out["funnel_count"] == 2 and out["used"] == "funnel"
    out = shaped("funnel", [STRAIGHT[0], (1, None, None, None, None), STRAIGHT[2]])
    assert [s["reason"] for s in out["sections"]] == ["missing_portal"] and out["sections"][0]["final_mode"] == "shortcut"
    assert (out["raw_count"], out["funnel_count"], out["final_count"]) == (4, 2, 2)
    out = shaped("funnel", [STRAIGHT[0], (None,) * 5, STRAIGHT[2]])
    assert [s["reason"] for s in out["sections"]] == ["edge_not_found"]
    bent = [STRAIGHT[0], (1, 0.015, 0.004, 0.015, 0.02), STRAIGHT[2]]
    assert len(shaped("funnel", bent)["points"]) == 2


def test_string_pull_corner():
    # The area tests are the fixed ones (right <= 0, left >= 0), so the first end of a gate is the clockwise one.
    gates = [((0, 0), (0, 0)), ((1, 1), (1, 2)), ((2, 1), (2, 2)), ((3, 0), (3, 0))]
    assert g.string_pull(gates) == [(0, 0), (1, 1), (2, 1), (3, 0)]


def hint(kind, spans, flags=0, code="", conf=0.9, cid=1):
    coords = [CHAIN[spans[0][0]], ((CHAIN[spans[0][0]][0] + CHAIN[spans[-1][1]][0]) / 2, 0.012), CHAIN[spans[-1][1]]]
    return (cid, code, kind, flags, conf, spans, coords)


def service(spark, hint_rows, raster=None):
    from lanegraph.plans.service import RouteService

    nodes = spark.createDataFrame([(i, i, y, x, 0, 0) for i, (x, y) in CHAIN.items()], NODE_DDL)
    edges = spark.createDataFrame([(i, i, i + 1, 1.0) for i in range(3)], EDGE_DDL)
    portals = spark.createDataFrame([(i, *map(float, g)) for i, *g in STRAIGHT], "edge_id int, ax double, ay double, bx double, by double")
    return RouteService(nodes, edges, spark.createDataFrame([], schemas.PORTS), raster or mask(), portals, spark.createDataFrame(hint_rows, HINT_DDL))


def test_hints(spark):
    """Hints on one path, in one table each: whether they shape it."""
    cases = [
        ([hint(1, [(0, 1), (1, 2)], code="AUMEL")], "aumel", None, 1, None),
        ([hint(1, [(0, 1), (1, 2)], code="AUMEL")], None, None, 0, None),
        ([hint(1, [(1, 2), (2, 3)], code="AUMEL")], "AUMEL", None, 0, None),
        ([hint(2, [(1, 2), (2, 3)], flags=1)], None, None, 1, None),
        ([hint(2, [(2, 1), (1, 0)], flags=1)], None, None, 1, None),
        ([hint(2, [(2, 1), (1, 0)], flags=0)], None, None, 0, None),
        ([hint(1, [(3, 2), (2, 1)], code="SGSIN")], None, "SGSIN", 1, None),  # matched backwards at the tail, whatever its flag
        ([hint(2, [(1, 2), (2, 3)], flags=1)], None, None, 0, mask((1, 2), (1, 3))),  # its line meets land
        ([], None, None, 0, None),
    ]
    for rows, start, end, want, raster in cases:
        paths = spark.createDataFrame([(7, [0, 1, 2, 3], "funnel", start, end), (8, [2], "funnel", start, end), (9, [], "funnel", start, end)], "path_id long, path_nodes array<int>, mode string, from_locode string, to_locode string")
        out = {r["path_id"]: r for r in service(spark, rows, raster).draw(paths).collect()}
        assert out[7]["shaped_count"] == want, (rows, start, end)
        assert out[8]["final_count"] == 1 and out[9]["final_count"] == 0
        if want:
            assert out[7]["points"][0] == list(CHAIN[0]) and out[7]["points"][-1] == list(CHAIN[3])


def test_best_hint_of_a_place(spark):
    """Of hints on the same legs the most confident with a safe line counts; port codes are compared in upper case."""
    rows = [hint(2, [(0, 1), (1, 2)], conf=c, cid=i) for i, c in enumerate((0.5, 0.9, 0.9, 0.2))]
    made = service(spark, rows)
    paths = spark.createDataFrame([(1, [0, 1, 2, 3], None, None)], "path_id long, path_nodes array<int>, from_locode string, to_locode string")
    ends = paths.select("path_id", F.size("path_nodes").alias("n_nodes"), "from_locode", "to_locode")
    found = hints.path_windows(g.path_legs(paths), ends, made.hints, made.raster).collect()
    assert [(w["kind"], w["n"], w["confidence"], w["start"]) for w in found] == [(1, 2, 0.9, 0)]
    two = spark.createDataFrame([hint(1, [(0, 1)], code="A", conf=0.5, cid=1), hint(1, [(0, 1)], code="a", conf=0.7, cid=2)], HINT_DDL)
    assert [r["corridor_id"] for r in hints.port_approaches(two).collect()] == [2]
    assert [r["corridor_id"] for r in hints.route_windows(made.hints).orderBy("place").collect()] == [1, 2, 0, 3]


def test_geometry_is_spread(spark):
    """Small rows with much work are dealt over many tasks, as searches are."""
    from lanegraph.shared import spread

    made = service(spark, [])
    paths = spark.range(200).select(F.col("id").alias("path_id"), F.array(*map(F.lit, range(4))).alias("path_nodes"), F.lit("funnel").alias("mode"), F.lit(None).alias("from_locode"), F.lit(None).alias("to_locode"))
    drawn = made.draw(paths)
    assert drawn.rdd.getNumPartitions() == spread(spark) and drawn.select(F.spark_partition_id()).distinct().count() > 4
    asked = spark.range(200).select(F.col("id").alias("request_id"), (F.col("id") % 4).cast("int").alias("from_node"), F.lit(3).alias("to_node"), F.lit("bidirectional-a-star").alias("algorithm"))
    assert search.route_requests(asked, made.nodes, made.edges).select(F.spark_partition_id()).distinct().count() > 4


def test_choose_windows():
    w = lambda kind, a, b, c=0.5: (kind, b - a, c, a, b, [])
    assert [x[3:5] for x in g.choose_windows([w(1, 0, 3), w(2, 2, 4), w(1, 4, 6), w(1, 4, 5, 0.9)])] == [(2, 4), (4, 6)]


@pytest.mark.parametrize("seed", range(5))
def test_smoothing_is_safe_and_keeps_ends(seed):
    r = random.Random(seed)
    raster = Raster.from_cells(60, 60, 1000.0, 0.0, 0.0, 60000.0, 60000.0, np.array([r.randrange(60) for _ in range(90)]), np.array([r.randrange(60) for _ in range(90)]))
    deg = 111319.49079327357
    points = [(0.05, 0.05)]
    while len(points) < 200:
        p = (points[-1][0] + r.uniform(-900, 900) / deg, points[-1][1] + r.uniform(-900, 900) / deg)
        if 0 < p[0] * deg < 59000 and 0 < p[1] * deg < 59000 and raster.safe(points[-1], p):
            points.append(p)
    out = g.shape_all([g.smooth(points)], raster)[0]
    one, at = [points[0]], 0
    while at < len(points) - 1:  # the farthest in sight, looked for one by one
        at = next((j for j in range(min(len(points) - 1, at + g.LOOKAHEAD), at + 1, -1) if raster.safe(points[at], points[j])), at + 1)
        one.append(points[at])
    assert out == one
    assert out[0] == points[0] and out[-1] == points[-1] and len(out) <= len(points)
    assert all(raster.safe(a, b) for a, b in zip(out, out[1:]))
    assert g.without_repeats(out) == out


def arrays(spark, points):
    return spark.createDataFrame([([list(map(float, p)) for p in points],)], "p array<array<double>>")


def test_columns(spark):
    df = arrays(spark, [(179, 0), (-179, 0)])
    assert df.select(g.split_segments(F.col("p"))).first()[0] == [[[179.0, 0.0]], [[-179.0, 0.0]]]
    assert df.select(g.renderable_segments(F.col("p"))).first()[0] == []
    assert arrays(spark, []).select(g.split_segments(F.col("p"))).first()[0] == []
    a, b = F.array(F.lit(99.5), F.lit(0.5)), F.array(F.lit(101.5), F.lit(2.5))
    assert len(df.select(g.with_endpoints(F.col("p"), a, b)).first()[0]) == 4
    drift = arrays(spark, [(0, 0), (8e-13, 0), (1.6e-12, 0), (5, 5), (5, 5)])
    assert drift.select(g.dedupe_points(F.col("p"))).first()[0] == [[0.0, 0.0], [1.6e-12, 0.0], [5.0, 5.0]]
    assert arrays(spark, []).select(g.dedupe_points(F.col("p"))).first()[0] == []
    twice = arrays(spark, [(0, 0), (0, 1e-13), (1, 1), (1, 1), (0, 0)])
    assert twice.select(g.dedupe_points(F.col("p"))).first()[0] == [[0.0, 0.0], [1.0, 1.0], [0.0, 0.0]]
    access = arrays(spark, [(-0.02, 0), (-0.01, 0), (0, 0)]).select(g.with_port_access(F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.03), F.lit(0.0))), F.col("p"), F.transform("p", lambda p: F.array(F.lit(0.03) - p[0], p[1])))).first()[0]
    assert len(access) == 6 and access[0] == [-0.02, 0.0] and access[-1] == [0.05, 0.0]


def test_hints_away_from_all_paths_are_left_out(spark):
    """Only hints whose first edge, or last one backwards, is a leg go on to be matched."""
    kind = "corridor_id long, spans array<struct<src:int,dst:int>>"
    asked = spark.createDataFrame([(1, [(1, 2), (2, 3)]), (2, [(7, 2), (2, 1)]), (3, [(2, 1), (9, 8)]), (4, [(5, 6)])], kind)
    legs = spark.createDataFrame([(1, 0, 1, 2), (1, 1, 2, 3)], "path_id long, pos int, src int, dst int")
    assert sorted(r["corridor_id"] for r in hints.on_legs(asked, legs).collect()) == [1, 2]


def test_other_modes_need_no_gates(spark):
    """Paths that are not pulled are drawn without reading portals or hints."""
    nodes = spark.createDataFrame([(i, y, x) for i, (x, y) in CHAIN.items()], "node_id int, lat double, lon double")
    paths = spark.createDataFrame([(1, [0, 1, 2, 3], "shortcut", None, None), (2, [2, 1], "raw", None, None)], "path_id long, path_nodes array<int>, mode string, from_locode string, to_locode string")
    service = RouteService.__new__(RouteService)
    service.nodes, service.raster, service.hints, service.portals, service.edges = nodes, mask(), "unread", "unread", "unread"
    used = {r["path_id"]: (r["used"], r["final_count"]) for r in service.draw(paths).collect()}
    assert used == {1: ("shortcut", 2), 2: ("raw", 2)}


def test_framed_walk_equals_cells_of_each():
    """Many segments of an opened mask, grid lines and corners among them, against the walk by rows and columns."""
    from lanegraph.operators import raster

    r = np.random.default_rng(8)
    grid = (r.random((40, 50)) < 0.02).astype(np.uint8)
    made = Flat(50, 40, 1000.0, 0.0, 0.0, 50000.0, 40000.0, bits=np.packbits(grid).tobytes())
    a, b = (np.stack([r.uniform(-0.5, 50.5, 4000), r.uniform(-0.5, 40.5, 4000)], 1) for _ in range(2))
    a[:1500], b[:1500] = np.round(a[:1500] * 2) / 2, np.round(b[:1500] * 2) / 2
    got = made.safe_many(a, b)
    limit, raster.MAX_OPEN_CELLS = raster.MAX_OPEN_CELLS, 0
    try:
        assert (got == made.safe_many(a, b)).all() and 0 < got.sum() < len(got)
    finally:
        raster.MAX_OPEN_CELLS = limit
