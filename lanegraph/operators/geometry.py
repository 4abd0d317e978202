"""From node paths to drawn routes.

Column functions (dedupe, anti-meridian split, endpoints, port access, GeoJSON) stay in the JVM, and joins
bring each path its points, portals and corridor hints. Line of sight, string pulling and splicing depend
on the step before, so they run in Arrow batches; all segments that a batch asks about are walked over the
raster together.
"""

from __future__ import annotations

import time
from collections.abc import Generator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanegraph.functions.geo import ANTIMERIDIAN_DEGREES, POINT_TOLERANCE
from lanegraph.operators.raster import Raster
from lanegraph.shared import spread

LOOKAHEAD = 128
#: So many of the points ahead are asked about at a time.
ASKED = 16
Point = tuple[float, float]
POINTS = "array<array<double>>"

# --- columns over arrays of [lon, lat] -------------------------------------------------------


def _no_points() -> Column:
    return F.array().cast(POINTS)


def _same(a: Column, b: Column) -> Column:
    return (F.abs(a[0] - b[0]) <= POINT_TOLERANCE) & (F.abs(a[1] - b[1]) <= POINT_TOLERANCE)


def dedupe_points(points: Column) -> Column:
    """Points without those that repeat the last kept one.

    That is the point before, unless some step is within the tolerance and yet not zero; only then is the array folded.
    """
    before = F.transform(points, lambda p, i: F.struct(p.alias("p"), F.get(points, i - 1).alias("q")))
    drift = F.exists(before, lambda z: F.coalesce(_same(z["p"], z["q"]) & (z["p"] != z["q"]), F.lit(False)))
    plain = F.transform(F.filter(before, lambda z: z["q"].isNull() | ~_same(z["p"], z["q"])), lambda z: z["p"])
    fold = F.aggregate(points, _no_points(), lambda kept, p: F.when((F.size(kept) > 0) & _same(F.element_at(kept, F.greatest(F.size(kept), F.lit(1))), p), kept).otherwise(F.concat(kept, F.array(p))))
    return F.when(drift, fold).otherwise(plain)


def split_segments(points: Column) -> Column:
    """Segments of points; a longitude step over 180 degrees begins a new one. No point is added, none is lost."""
    start = F.filter(F.sequence(F.lit(0), F.size(points) - 1), lambda i: (i == 0) | (F.abs(F.get(points, i)[0] - F.get(points, i - 1)[0]) > ANTIMERIDIAN_DEGREES))
    ends = F.concat(F.slice(start, F.lit(2), F.size(start)), F.array(F.size(points)))
    cut = F.transform(F.arrays_zip(start.alias("a"), ends.alias("b")), lambda z: F.slice(points, z["a"] + 1, z["b"] - z["a"]))
    return F.when(F.size(points) > 0, cut).otherwise(F.array().cast(f"array<{POINTS}>"))


def renderable_segments(points: Column) -> Column:
    return F.filter(split_segments(points), lambda s: F.size(s) >= 2)


def with_endpoints(points: Column, start: Column, end: Column) -> Column:
    """Raw ends put before and after the points; ends that are not [lon, lat] are left out."""
    one = lambda e: F.when(F.size(F.coalesce(e, F.array().cast("array<double>"))) == 2, F.array(e)).otherwise(_no_points())
    return F.concat(one(start), points, one(end))


def with_port_access(points: Column, start_path: Column, end_path: Column) -> Column:
    """Access paths of the two ports stitched on: the first without its last point, the second reversed and without it; then deduped."""

    def most(path: Column) -> Column:
        return F.when(F.size(F.coalesce(path, _no_points())) >= 2, F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(_no_points())

    return dedupe_points(F.concat(most(start_path), points, F.reverse(most(end_path))))


def feature_collection(segments: Column) -> Column:
    """GeoJSON text: one LineString feature per segment, no properties."""
    feature = lambda s: F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), s.alias("coordinates")).alias("geometry"), F.create_map().cast("map<string,string>").alias("properties"))
    return F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform(segments, feature).alias("features")))


def raw_points(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """path_id and points [lon, lat] of its nodes in order."""
    at = paths.select("path_id", F.posexplode("path_nodes").alias("pos", "node_id")).join(nodes.select("node_id", "lat", "lon"), "node_id")
    point = F.struct("pos", F.array(F.col("lon").cast("double"), F.col("lat").cast("double")).alias("p"))
    return at.groupBy("path_id").agg(F.transform(F.sort_array(F.collect_list(point)), lambda s: s["p"]).alias("points"))


def path_legs(paths: DataFrame) -> DataFrame:
    """path_id, pos, src, dst of consecutive nodes."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("path_nodes") - 1), lambda i: F.struct(F.get("path_nodes", i - 1).alias("src"), F.get("path_nodes", i).alias("dst")))
    return paths.where(F.size("path_nodes") > 1).select("path_id", F.posexplode(pairs).alias("pos", "leg")).select("path_id", "pos", "leg.*")


def path_edges(paths: DataFrame, first: DataFrame) -> DataFrame:
    """path_id, pos, src, dst, edge_id (null if there is no such edge) of consecutive nodes; ``first`` maps (src, dst) to the first edge."""
    return path_legs(paths).join(first, ["src", "dst"], "left")


def mode_used(requested: Column, has_mask: Column, has_portals: Column) -> Column:
    """The mode that the requested one comes down to with what is loaded."""
    return F.when((requested == "raw") | ~has_mask, "raw").when((requested == "shortcut") | ~has_portals, "shortcut").otherwise("funnel")


# --- shapes in workers -----------------------------------------------------------------------


def area2(a: Point, b: Point, c: Point) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def near(a: Point, b: Point) -> bool:
    return abs(a[0] - b[0]) <= POINT_TOLERANCE and abs(a[1] - b[1]) <= POINT_TOLERANCE


def without_repeats(points: list[Point]) -> list[Point]:
    out: list[Point] = []
    for p in points:
        if not out or not near(out[-1], p):
            out.append(p)
    return out


def runs_of(points: list[Point]) -> list[tuple[int, int]]:
    """Half-open index ranges between longitude jumps."""
    cuts = [0, *(i for i in range(1, len(points)) if abs(points[i][0] - points[i - 1][0]) > ANTIMERIDIAN_DEGREES), len(points)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def string_pull(portals: list[tuple[Point, Point]]) -> list[Point]:
    """Shortest line through portals (left, right), by the funnel algorithm: each side narrows in turn; where one would cross the other, the other's end is a corner and the funnel starts again from it."""
    path = [portals[0][0]]
    apex = portals[0][0]
    ends = {"left": (apex, 0), "right": (portals[0][1], 0)}
    i = 1
    while i < len(portals):
        restart = None
        for side, other, sign, k in (("right", "left", 1.0, 1), ("left", "right", -1.0, 0)):
            candidate = portals[i][k]
            if sign * area2(apex, ends[side][0], candidate) > 0:
                continue  # would widen the funnel
            if near(apex, ends[side][0]) or sign * area2(apex, ends[other][0], candidate) > 0:
                ends[side] = (candidate, i)
            else:
                restart = ends[other]
                break
        if restart is not None:
            apex, i = restart
            path.append(apex)
            ends = {"left": restart, "right": restart}
        i += 1
    path.append(portals[-1][0])
    return path


PORT_APPROACH, ROUTE_WINDOW, BIDIRECTIONAL = 1, 2, 1

#: The shapes below are generators: they yield the segments whose safety they need next and are sent the answers, so
#: that a batch of paths asks for all its segments together (``shape_all``).
Asking = Generator[list[tuple[Point, Point]], list[bool], object]
#: (edge, ax, ay, bx, by) of a leg; no edge, or no ax, where there is none.
Gate = tuple[int | None, float | None, float | None, float | None, float | None]
#: (kind, edges, confidence, start, end, line) of a corridor hint found on a path.
Found = tuple[int, int, float, int, int, list[Point]]


def smooth_run(points: list[Point]) -> Asking:
    """From each point on to the farthest one in sight, at most LOOKAHEAD ahead, else to the next."""
    if len(points) < 3:
        return without_repeats(points)
    out, at, end = [points[0]], 0, len(points) - 1
    while at < end:
        step, top = at + 1, min(end, at + LOOKAHEAD)
        while top > at + 1:
            tried = range(top, max(at + 1, top - ASKED), -1)
            seen = yield [(points[at], points[j]) for j in tried]
            step = next((j for j, ok in zip(tried, seen) if ok), at + 1)
            if step > at + 1:
                break
            top = tried[-1] - 1
        at = step
        out.append(points[at])
    return out


def smooth(points: list[Point]) -> Asking:
    if len(points) < 3:
        return without_repeats(points)
    out: list[Point] = []
    for a, b in runs_of(points):
        out += yield from smooth_run(points[a:b])
    return without_repeats(out)


def all_safe(points: list[Point]) -> Asking:
    return all((yield list(zip(points, points[1:])))) if len(points) > 1 else True


def pull_run(points: list[Point], gates: list[Gate]) -> Asking:
    """(pulled line, None), or (None, why there is none)."""
    if len(points) < 3:
        return without_repeats(points), None
    ends = [(points[0], points[0])]
    for k, (edge, ax, ay, bx, by) in enumerate(gates):
        if edge is None:
            return None, "edge_not_found"
        if ax is None:
            return None, "missing_portal"
        ends.append(((ax, ay), (bx, by)) if area2(points[k], points[k + 1], (ax, ay)) >= 0 else ((bx, by), (ax, ay)))
    line = string_pull([*ends, (points[-1], points[-1])])
    if len(line) < 2:
        return None, "degenerate_funnel"
    if not (yield from all_safe(line)):
        return None, "unsafe_funnel_segment"
    return without_repeats(line), None


def pull(points: list[Point], gates: list[Gate]) -> Asking:
    """Final points, number of points before the clean-up, and a record of each run that fell back to line of sight."""
    pulled, final, fallbacks = [], [], []
    for a, b in runs_of(points):
        line, why = yield from pull_run(points[a:b], gates[a : b - 1])
        if why is None:
            pulled += line
            final += yield from smooth(line)
        else:
            line = yield from smooth(points[a:b])
            pulled += line
            final += line
            fallbacks.append({"start": a, "end": b - 1, "base_mode": "funnel", "final_mode": "shortcut", "reason": why})
    return without_repeats(final), len(without_repeats(pulled)), fallbacks


def corridor_line(coords: list[Point]) -> Asking:
    """What is drawn for a corridor: its points where it is safe throughout, cleaned up; else None."""
    if len(coords) < 2 or not (yield from all_safe(coords)):
        return None
    line = yield from smooth(coords)
    return line if len(line) >= 2 and (yield from all_safe(line)) else None


def choose_windows(found: list[Found]) -> list[Found]:
    """Windows that do not overlap (touching ends may meet): by kind, edges, confidence, then earliest first; back in route order."""
    chosen: list[Found] = []
    for w in sorted(found, key=lambda w: (-w[0], -w[1], -w[2], w[3])):
        if all(w[4] <= c[3] or w[3] >= c[4] for c in chosen):
            chosen.append(w)
    return sorted(chosen, key=lambda w: (w[3], w[4]))


def splice(points: list[Point], gates: list[Gate], found: list[Found]) -> Asking:
    """The route with the chosen windows' lines in place of theirs, and how many were chosen."""
    chosen = choose_windows(found)
    out: list[Point] = []
    at = 0
    for w in chosen:
        if w[3] > at:
            out += (yield from pull(points[at : w[3] + 1], gates[at : w[3]]))[0]
        out += w[5]
        at = w[4]
    if chosen and at < len(points) - 1:
        out += (yield from pull(points[at:], gates[at:]))[0]
    return without_repeats(out), len(chosen)


def shape(mode: str, points: list[Point], gates: list[Gate] | None, found: list[Found], masked: bool) -> Asking:
    """The path's line in the mode that the requested one comes down to, with what led to it."""
    out = {"requested": mode, "used": "raw", "raw_count": len(points), "funnel_count": None, "fallback_count": 0, "shaped_count": 0, "sections": [], "points": points}
    if mode == "raw" or not masked:
        pass
    elif mode == "shortcut" or gates is None:
        out |= {"used": "shortcut", "points": (yield from smooth(points))}
    else:
        line, funnel_count, sections = yield from pull(points, gates)
        out |= {"used": "funnel", "points": line, "funnel_count": funnel_count, "fallback_count": len(sections), "sections": sections}
        if found and len(points) >= 2:
            line, n = yield from splice(points, gates, found)
            if n:
                out |= {"points": line, "shaped_count": n}
    return out | {"final_count": len(out["points"])}


def shape_all(shapes: list[Asking], raster: Raster | None) -> list:
    """Runs all shapes side by side: a round answers the questions of all that still ask in one pass over the mask."""
    out: list = [None] * len(shapes)
    waiting: dict[int, list[bool] | None] = dict.fromkeys(range(len(shapes)))
    while waiting:
        asked: dict[int, list[tuple[Point, Point]]] = {}
        for i, seen in waiting.items():
            try:
                asked[i] = shapes[i].send(seen)
            except StopIteration as done:
                out[i] = done.value
        flat = np.array([pair for pairs in asked.values() for pair in pairs], float).reshape(-1, 2, 2)
        seen = raster.safe_many(flat[:, 0], flat[:, 1]).tolist() if len(flat) else []
        ends = np.cumsum([len(p) for p in asked.values()]).tolist()
        waiting = {i: seen[e - len(p) : e] for (i, p), e in zip(asked.items(), ends)}
    return out


# --- shapes of tables ------------------------------------------------------------------------

LINE = pa.list_(pa.list_(pa.float64()))


def leg_gates(first: DataFrame, portals: DataFrame) -> DataFrame:
    """src, dst, edge_id and the portal's ends (null without a portal) of each pair of neighbouring nodes."""
    return first.join(portals.select("edge_id", "ax", "ay", "bx", "by"), "edge_id", "left").select("src", "dst", "edge_id", *[F.col(c).cast("double").alias(c) for c in ("ax", "ay", "bx", "by")])


def hint_lines(hints: DataFrame, raster: Raster) -> DataFrame:
    """corridor_id, backwards, line of each hint and direction that is safe throughout. They depend on the mask only, not on the path."""
    sent = hints.sparkSession.sparkContext.broadcast(raster)

    def run(batches):
        for b in batches:
            coords = [[(c["lon"], c["lat"]) for c in cs or []] for cs in b.column(1).to_pylist()]
            both = [x for c in coords for x in (c, c[::-1])]
            lines = shape_all([corridor_line(c) for c in both], sent.value)
            ids = np.repeat(b.column(0).to_numpy(), 2)
            keep = [i for i, x in enumerate(lines) if x is not None]
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array([i % 2 == 1 for i in keep], pa.bool_()), pa.array([[list(p) for p in lines[i]] for i in keep], LINE)], names=["corridor_id", "backwards", "line"])

    narrow = hints.select(F.col("corridor_id").cast("long"), "coords").repartition(spread(hints.sparkSession), "corridor_id")
    return narrow.mapInArrow(run, f"corridor_id long, backwards boolean, line {POINTS}")


SECTIONS = "array<struct<start:int,end:int,base_mode:string,final_mode:string,reason:string>>"
GEOMETRY = f"path_id long, points {POINTS}, requested string, used string, raw_count int, funnel_count int, final_count int, fallback_count int, shaped_count int, sections {SECTIONS}, shape_ms double"


def build_geometry(paths: DataFrame, nodes: DataFrame, raster: Raster | None = None, gates: DataFrame | None = None, windows: DataFrame | None = None, timed: bool = False) -> DataFrame:
    """GEOMETRY of every path (path_id, path_nodes, mode).

    ``gates``: what ``leg_gates`` gives; ``windows``: path_id, kind, n, confidence, start, end, line. Each path meets its points,
    gates and windows in joins; only the mask, of fixed size, is broadcast. Paths are dealt over ``spread`` tasks, since
    their rows are small and their work is not. ``timed`` shapes them one by one and fills ``shape_ms``.
    """
    spark = paths.sparkSession
    rows = paths.select(F.col("path_id").cast("long").alias("path_id"), F.col("path_nodes").cast("array<int>").alias("path_nodes"), "mode")
    ready = rows.select("path_id", "mode").join(raw_points(rows, nodes), "path_id", "left")
    gate = "array<struct<pos:int,edge_id:int,ax:double,ay:double,bx:double,by:double>>"
    found = "array<struct<kind:int,n:int,confidence:double,start:int,end:int,line:array<array<double>>>>"
    if gates is not None and raster is not None:
        legs = path_edges(rows, gates).groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("pos", "edge_id", "ax", "ay", "bx", "by"))).cast(gate).alias("gates"))
        ready = ready.join(legs, "path_id", "left").withColumn("gates", F.coalesce("gates", F.array().cast(gate)))
    else:
        ready = ready.withColumn("gates", F.lit(None).cast(gate))
    if windows is not None:
        per = windows.groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("kind", "n", "confidence", "start", "end", "line"))).cast(found).alias("windows"))
        ready = ready.join(per, "path_id", "left")
    else:
        ready = ready.withColumn("windows", F.lit(None).cast(found))
    sent = spark.sparkContext.broadcast(raster)
    section = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("base_mode", pa.string()), ("final_mode", pa.string()), ("reason", pa.string())])
    kinds = {"points": LINE, "requested": pa.string(), "used": pa.string(), "raw_count": pa.int32(), "funnel_count": pa.int32(), "final_count": pa.int32(), "fallback_count": pa.int32(), "shaped_count": pa.int32(), "sections": pa.list_(section), "shape_ms": pa.float64()}

    def run(batches):
        for b in batches:
            shapes = []
            for mode, points, gates, windows in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
                legs = None if gates is None else [(g["edge_id"], g["ax"], g["ay"], g["bx"], g["by"]) for g in gates]
                hits = [(w["kind"], w["n"], w["confidence"], w["start"], w["end"], [tuple(p) for p in w["line"]]) for w in windows or []]
                shapes.append(shape(mode, [tuple(p) for p in points or []], legs, hits, sent.value is not None))
            if timed:
                made, took = [], []
                for one in shapes:
                    start = time.perf_counter()
                    made += shape_all([one], sent.value)
                    took.append((time.perf_counter() - start) * 1000)
            else:
                made, took = shape_all(shapes, sent.value), [None] * len(shapes)
            made = [m | {"points": [list(p) for p in m["points"]], "shape_ms": t} for m, t in zip(made, took)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([m[k] for m in made], t) for k, t in kinds.items())], names=["path_id", *kinds])

    return ready.select("path_id", "mode", "points", "gates", "windows").repartition(spread(spark), "path_id").mapInArrow(run, GEOMETRY)
