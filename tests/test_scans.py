"""Scans in pieces against windows over whole keys, and hint runs against comparing every edge."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lanegraph.operators import hints, scans


def tracks(spark, n=4000):
    r = random.Random(6)
    rows = [(r.choice([1, 1, 1, 1, 2, None, 3 + i]), r.randrange(n), i, r.uniform(-180, 180)) for i in range(n)]
    return spark.createDataFrame(rows, "track_id int, seq int, id int, lon double").repartition(5)


@pytest.mark.parametrize("ranges", [1, 13])
def test_runs_equal_a_window_over_the_track(spark, ranges):
    points = tracks(spark)
    w = Window.partitionBy("track_id").orderBy("seq", "id")
    jump = F.coalesce((F.abs(F.col("lon") - F.lag("lon").over(w)) > 180).cast("int"), F.lit(0))
    want = points.withColumn("jump", jump).select("id", F.sum("jump").over(w).alias("run"))
    got = scans.track_runs(points, order=["seq", "id"], ranges=ranges)
    assert got.columns == [*points.columns, "run"]
    assert {r["id"]: r["run"] for r in got.collect()} == {r["id"]: r["run"] for r in want.collect()}
    assert scans.track_runs(points.limit(0), order=["seq", "id"]).count() == 0


def test_one_long_track_is_dealt_over_tasks(spark):
    points = spark.range(1_000_000).select(F.lit(1).alias("track_id"), F.col("id").alias("seq"), F.when(F.col("id") % 1000 < 500, 170.0).otherwise(-170.0).alias("lon"))
    sizes = [r["count"] for r in scans.pieces(points, ["track_id"], ["seq"], 8).groupBy("__range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 250_000
    assert scans.track_runs(points, ranges=8).agg(F.max("run")).first()[0] == 1999


@pytest.mark.parametrize("ranges", [1, 9])
def test_nearest_rank_equals_the_sorted_list(spark, ranges):
    r = random.Random(1)
    rows = [("all", float(r.randrange(-50, 50))) for _ in range(3000)] + [("one", -3.5), ("none", None), (None, 2.0), (None, 7.0)] + [("same", 4.0)] * 500 + [("gap", None if i % 3 else float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "name string, v double").repartition(4)
    for share in (0.95, 0.5, 0.0, 1.0):
        got = {x["name"]: x["p"] for x in scans.nearest_rank(df, ["name"], "v", share, "p", ranges).collect()}
        for name in ("all", "one", "none", None, "same", "gap"):
            values = sorted(v for k, v in rows if k == name and v is not None)
            assert got[name] == (values[max(1, math.ceil(share * len(values) - 1e-9)) - 1] if values else None), (name, share)
        want = {x["name"]: x["p"] for x in df.groupBy("name").agg(F.expr(f"percentile_disc({share}) within group (order by v)").alias("p")).collect()}
        assert got == want


HINT = "corridor_id long, locode string, kind short, flags short, confidence double, spans array<struct<src:int,dst:int>>, coords array<struct<lon:double,lat:double>>"


def brute(paths, rows):
    out = set()
    for p, edges in paths.items():
        for cid, flags, spans in rows:
            for back in (False, True):
                run = [(b, a) for a, b in reversed(spans)] if back else spans
                out |= {(p, cid, back, i, len(run), flags) for i in range(len(edges) - len(run) + 1) if edges[i : i + len(run)] == run}
    return out


def test_runs_of_hints_on_paths(spark):
    """Random walks on few nodes, so that edges repeat; hints of many lengths, palindromes, repeated ids and gaps in a path."""
    r = random.Random(3)
    paths = {}
    for p in range(40):
        nodes = [r.randrange(4)]
        while len(nodes) < r.randrange(3, 40):
            nodes.append((nodes[-1] + r.choice([1, 2, 3])) % 4)
        paths[p] = list(zip(nodes, nodes[1:]))
    rows = []
    for i in range(60):
        edges = paths[r.randrange(40)]
        lo = r.randrange(len(edges))
        rows.append((i % 50, r.randrange(4), edges[lo : lo + r.randrange(1, 9)]))
    rows += [(70, 0, [(0, 1), (1, 0)]), (71, 1, [(9, 9)]), rows[0]]
    legs = spark.createDataFrame([(p, i, a, b) for p, e in paths.items() for i, (a, b) in enumerate(e)] + [(99, 0, 0, 1), (99, 2, 1, 2)], "path_id long, pos int, src int, dst int")
    table = spark.createDataFrame([(c, "", 1, f, 0.5, s, [(0.0, 0.0), (1.0, 1.0)]) for c, f, s in rows], HINT)
    got = {(x["path_id"], x["corridor_id"], x["backwards"], x["start"], x["n"], x["flags"]) for x in hints._matches(legs, table).collect()}
    assert got == brute(paths | {99: [(0, 1)]}, rows) | {x for x in brute({99: [(1, 2)]}, rows) for x in [(99, x[1], x[2], 2, x[4], x[5])] if x[4] == 1}
    assert hints._matches(legs, table.limit(0)).count() == 0


def test_an_edge_on_every_path_and_hint_makes_no_product(spark):
    """One edge is shared by 300 paths and 200 hints; what is joined are the true windows."""
    legs = spark.createDataFrame([(p, i, *e) for p in range(300) for i, e in enumerate([(p + 1000, 1), (1, 2), (2, p + 5000)])], "path_id long, pos int, src int, dst int")
    table = spark.createDataFrame([(h, "", 1, 0, 0.5, [(h + 1000, 1), (1, 2), (2, h + 5000)], [(0.0, 0.0), (1.0, 1.0)]) for h in range(200)], HINT)
    met = hints.run_candidates(legs, hints._steps(table))
    assert met.count() == 200 == hints._matches(legs, table).count()


def test_equal_hints_go_by_their_place_in_the_file(spark):
    rows = [(9, "P", 1, 0, 0.5, [(0, 1)], [(0.0, 0.0)] * 2, 0), (2, "p", 1, 0, 0.5, [(1, 2)], [(0.0, 0.0)] * 2, 1), (7, "", 2, 0, 0.5, [(0, 1)], [(0.0, 0.0)] * 2, 2), (3, "", 2, 0, 0.5, [(0, 1)], [(0.0, 0.0)] * 2, 3)]
    table = spark.createDataFrame(rows, HINT + ", position int")
    assert hints.port_approaches(table).first()["corridor_id"] == 9
    assert hints.port_approaches(table.drop("position")).first()["corridor_id"] == 2
    assert [r["corridor_id"] for r in hints.route_windows(table).orderBy("place").collect()] == [7, 3]
    assert [r["corridor_id"] for r in hints.route_windows(table.drop("position")).orderBy("place").collect()] == [3, 7]
