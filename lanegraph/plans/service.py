"""The whole route service over DataFrames of requests: what an HTTP front end would call."""

from __future__ import annotations

import resource
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanegraph.functions.geo import clamp_iterations, resolve_algorithm, resolve_mode
from lanegraph.operators import geometry, network, search
from lanegraph.operators.hints import FEW, path_windows
from lanegraph.operators.ports import list_ports, port_by_locode, port_warnings, snap_ports, unique_locodes
from lanegraph.operators.raster import Raster
from lanegraph.operators.snap import nearest, snap_coordinates
from lanegraph.shared import materialize, spread

# The preset benchmark's scenarios.
PRESETS = [
    ("west_aus_to_java", "AUFRE", "IDJKT"),
    ("east_aus_to_java", "AUSYD", "IDJKT"),
    ("melbourne_to_singapore", "AUMEL", "SGSIN"),
]
RESPONSE = ["request_id", "success", "error_code", "error_message", "total_distance_nm", "total_cost", "node_count", "geometry", "raw_geometry", "mode_requested", "mode_used", "diagnostics"]


#: Loading phases: reading the artifacts, and making the network and the gates of geometry from them.
PHASES = ("graph", "ports", "portals", "hints", "mask", "network", "geometry")


def _working_set() -> int:
    """The largest resident size of the driver's Python process so far."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024


@dataclass
class RouteService:
    """Loaded network and side tables. Without mask, portals or hints the geometry modes step down as documented in ``geometry.mode_used``."""

    nodes: DataFrame
    edges: DataFrame
    ports: DataFrame
    raster: Raster | None = None
    portals: DataFrame | None = None
    hints: DataFrame | None = None
    default_mode: str | None = None
    default_algorithm: str | None = None
    max_snap_nm: float = 100.0
    resolution: int = 5
    #: Portals of some edges, where they can be made without the table of all.
    portals_of: Callable[[DataFrame], DataFrame] | None = None

    def __post_init__(self):
        self.timings: dict[str, float] = {}
        self.marks: DataFrame | None = None  # landmark distances for searches by joins
        unique_locodes(self.ports)

    def _timed(self, name: str, make):
        start = time.monotonic()
        out = make()
        self.timings[name] = (time.monotonic() - start) * 1000
        return out

    @cached_property
    def csr(self) -> search.Csr | None:
        """The network for broadcasting, or None beyond its bound (then searches join frontiers)."""
        return self._timed("network", lambda: search.load_network(self.nodes, self.edges, True) if search.fits(self.edges) else None)

    @cached_property
    def gates(self) -> DataFrame | None:
        """First edges of neighbouring nodes with their portals, written once."""
        if self.portals is None:
            return None
        return self._timed("geometry", lambda: materialize(geometry.leg_gates(network.first_edges(self.edges), self.portals), "gates"))

    def gates_of(self, legs: DataFrame) -> DataFrame | None:
        """The gates of the legs (src, dst) that are drawn: where they are few, of these alone."""
        if self.portals is None or "gates" in self.__dict__:
            return self.gates
        legs = materialize(legs.select("src", "dst").distinct(), "drawn")
        if FEW * legs.count() >= self.edges.count():
            return self.gates
        first = materialize(network.first_edges(self.edges.join(legs, ["src", "dst"], "left_semi")), "first")
        portals = self.portals_of(first) if self.portals_of else self.portals.join(first.select("edge_id"), "edge_id", "left_semi")
        return materialize(geometry.leg_gates(first, portals), "gates")

    def draw(self, paths: DataFrame, timed: bool = False) -> DataFrame:
        """Geometry of paths (path_id, path_nodes, mode, from_locode, to_locode)."""
        paths = materialize(paths, "paths")  # read for points, legs and hints
        pulled = paths.where(F.col("mode") == "funnel")
        if not pulled.limit(1).count():  # gates and hints shape pulled paths only
            return geometry.build_geometry(paths, self.nodes, self.raster, None, None, timed)
        windows, legs = None, geometry.path_legs(pulled)
        gates = self.gates_of(legs)
        if self.hints is not None and self.raster is not None and gates is not None:
            ends = pulled.select("path_id", F.size("path_nodes").alias("n_nodes"), F.col("from_locode").cast("string"), F.col("to_locode").cast("string"))
            windows = path_windows(legs, ends, self.hints, self.raster)
        return geometry.build_geometry(paths, self.nodes, self.raster, gates, windows, timed)

    def _options(self, requests: DataFrame) -> DataFrame:
        text = lambda c: F.col(c).cast("string") if c in requests.columns else F.lit(None).cast("string")
        return requests.withColumns({
            "mode": resolve_mode(text("mode"), F.lit(self.default_mode).cast("string")),
            "algorithm": resolve_algorithm(text("algorithm"), F.lit(self.default_algorithm).cast("string")),
        })

    def _solve(self, asked: DataFrame, error: Column, stitch) -> DataFrame:
        """RESPONSE for requests with from_node, to_node and two codes; ``error`` marks those that failed before the search."""
        asked = materialize(asked.withColumn("early", error), "asked")
        ready = asked.where("early is null")
        routed = materialize(search.route_requests(ready, self.nodes, self.edges, csr=self.csr), "routed")
        good = routed.where("status = 'Success'").join(ready.select("request_id", "mode", "from_locode", "to_locode"), "request_id")
        paths = good.select(F.col("request_id").alias("path_id"), "path_nodes", "mode", "from_locode", "to_locode")
        drawn = self.draw(paths).withColumnRenamed("path_id", "request_id")
        raw = geometry.raw_points(paths.select("path_id", "path_nodes"), self.nodes).select(F.col("path_id").alias("request_id"), F.col("points").alias("raw_points"))
        full = asked.join(routed, "request_id", "left").join(drawn, "request_id", "left").join(raw, "request_id", "left")
        ok = F.coalesce(F.col("status") == "Success", F.lit(False))
        diagnostics = F.struct("requested", "used", "raw_count", "funnel_count", "final_count", "fallback_count", "shaped_count", "sections")
        return full.select(
            "request_id",
            ok.alias("success"),
            F.when(~ok, F.coalesce("early", F.upper("status"))).alias("error_code"),
            F.when(~ok, F.coalesce("failure_reason", F.col("early"))).alias("error_message"),
            "total_distance_nm",
            "total_cost",
            F.when(ok, F.size("path_nodes")).alias("node_count"),
            F.when(ok, geometry.feature_collection(geometry.split_segments(stitch(F.col("points"))))).alias("geometry"),
            F.when(ok, geometry.feature_collection(geometry.split_segments(F.col("raw_points")))).alias("raw_geometry"),
            F.col("requested").alias("mode_requested"),
            F.col("used").alias("mode_used"),
            F.when(ok, diagnostics).alias("diagnostics"),
        )

    def route_by_locode(self, requests: DataFrame) -> DataFrame:
        """RESPONSE of requests (request_id, from_locode, to_locode, and perhaps mode, algorithm)."""
        asked = self._options(requests)
        for side in ("from", "to"):
            code = F.upper(f"{side}_locode")
            port = self.ports.select(F.upper("locode").alias(f"{side}_code"), F.col("marine_access_path_coordinates").alias(f"{side}_path"))
            asked = asked.join(port, code == F.col(f"{side}_code"), "left")
            at = snap_ports(self.ports.select("locode"), self.ports, self.nodes).select(F.upper("locode").alias(f"{side}_at"), F.col("node_id").alias(f"{side}_node"))
            asked = asked.join(at, code == F.col(f"{side}_at"), "left").drop(f"{side}_at")
        unknown = F.col("from_code").isNull() | F.col("to_code").isNull()
        lost = (F.col("from_node") < 0) | (F.col("to_node") < 0)
        error = F.when(unknown | lost, "PORT_NOT_FOUND")
        return self._solve(asked, error, lambda p: geometry.with_port_access(p, F.col("from_path"), F.col("to_path")))

    def route_by_coordinate(self, requests: DataFrame) -> DataFrame:
        """RESPONSE of requests (request_id, from_lat, from_lon, to_lat, to_lon, and perhaps mode, algorithm)."""
        asked = self._options(requests)
        for side in ("from", "to"):
            points = requests.select(F.col("request_id").alias("query_id"), F.col(f"{side}_lat").alias("lat"), F.col(f"{side}_lon").alias("lon"))
            at = snap_coordinates(points, self.nodes, self.max_snap_nm).select(F.col("query_id").alias("request_id"), F.col("node_id").alias(f"{side}_node"))
            asked = asked.join(materialize(at, "snapped"), "request_id")  # one end's candidates at a time
        asked = asked.withColumns({"from_locode": F.lit(None).cast("string"), "to_locode": F.lit(None).cast("string")})
        error = F.when((F.col("from_node") < 0) | (F.col("to_node") < 0), "SNAP_FAILED")
        end = lambda s: F.array(F.col(f"{s}_lon").cast("double"), F.col(f"{s}_lat").cast("double"))
        return self._solve(asked, error, lambda p: geometry.with_endpoints(p, end("from"), end("to")))

    def snap(self, points: DataFrame, k: int = 5, radius_nm: float | None = None) -> DataFrame:
        """query_id, rank, node_id, lat, lon, distance_nm, component_id, node_class of the nearest nodes."""
        near = nearest(points, self.nodes, k, radius_nm or self.max_snap_nm)
        return near.join(self.nodes.select("node_id", "lat", "lon", "node_class"), "node_id").select("query_id", "rank", "node_id", "lat", "lon", "distance_nm", "component_id", "node_class")

    def list_ports(self) -> DataFrame:
        return list_ports(self.ports)

    def port(self, locode: str) -> DataFrame:
        return port_by_locode(self.ports, locode)

    def warnings(self) -> DataFrame:
        return port_warnings(self.ports, self.nodes)

    def stats(self) -> DataFrame:
        return network.graph_stats(self.nodes, self.edges, self.ports, self.resolution)

    def health(self) -> DataFrame:
        one = self.stats()
        up = F.col("node_count") > 0
        return one.select(F.when(up, "ok").otherwise("unavailable").alias("status"), F.when(up, "network is loaded").otherwise("network is empty").alias("message"), "node_count", "edge_count", "port_count")

    def profile(self) -> DataFrame:
        """Times of the loading phases so far, each artifact's own if they were read by ``bundle.load_bundle``, the driver's memory, and the counts of ``stats``."""
        _ = self.csr, self.gates
        stats = self.stats()
        times = [F.lit(round(self.timings.get(n, 0.0), 3)).alias(f"{n}_ms") for n in PHASES]
        runtime = self.nodes.sparkSession._jvm.java.lang.Runtime.getRuntime()
        memory = [F.lit(runtime.totalMemory() - runtime.freeMemory()).cast("long").alias("heap_bytes"), F.lit(_working_set()).cast("long").alias("working_set_bytes")]
        return stats.select(F.lit(round(sum(self.timings.values()), 3)).alias("startup_ms"), *times, *memory, "node_count", "edge_count", "port_count", "component_count", F.lit(self.raster is not None).alias("smoothing"))

    def _search_by_joins(self, runs: DataFrame, iterations: int) -> DataFrame:
        """SEARCHED of runs on a network beyond the broadcast bound. The pairs of an iteration advance together, so each has the time of its iteration."""
        if self.marks is None:
            self.marks = materialize(search.landmark_table(self.nodes, self.edges, 0), "marks")
        runs = materialize(runs.withColumn("request_id", F.xxhash64("name", "algorithm", "mode", "from_locode", "to_locode", "iteration")), "runs")
        made = []
        for i in range(1, iterations + 1):
            asked = runs.where(F.col("iteration") == i)
            start = time.perf_counter()
            found = materialize(search.route_by_frontier(asked.select("request_id", F.col("s").alias("from_node"), F.col("t").alias("to_node"), "algorithm"), self.nodes, self.edges, self.marks), "iteration")
            made.append(asked.join(found, "request_id").withColumn("search_ms", F.lit((time.perf_counter() - start) * 1000)))
        both = reduce(DataFrame.unionByName, made)
        as_is = {c.split()[0]: c.split()[1] for c in SEARCHED.split(", ")}
        both = both.withColumns({"success": F.col("status") == "Success", "distance_nm": F.col("total_distance_nm"), "failure": F.col("failure_reason")})
        return both.select(*[F.col(c).cast(kind).alias(c) for c, kind in as_is.items()])

    def benchmark_runs(self, pairs: DataFrame, iterations: int | None = None, default_iterations: int = 5) -> DataFrame:
        """One row per run of every pair (name, from_locode, to_locode): times of search and shaping measured in the workers (of a search by joins: around it), results, failures."""
        n = clamp_iterations(F.lit(iterations).cast("int"), default_iterations)
        sent = pairs.sparkSession.sparkContext.broadcast(self.csr)
        at = snap_ports(self.ports.select("locode"), self.ports, self.nodes).select(F.upper("locode").alias("code"), "node_id")
        p = self._options(pairs).join(at.toDF("fc", "from_node"), F.upper("from_locode") == F.col("fc"), "left").join(at.toDF("tc", "to_node"), F.upper("to_locode") == F.col("tc"), "left")
        runs = p.select("name", "from_locode", "to_locode", "mode", "algorithm", F.coalesce("from_node", F.lit(-1)).alias("s"), F.coalesce("to_node", F.lit(-1)).alias("t"), F.explode(F.sequence(F.lit(1), n)).alias("iteration"))
        runs = runs.repartition(spread(pairs.sparkSession), "name", "from_locode", "to_locode", "iteration")

        def run(frames):
            import pandas as pd

            for f in frames:
                out = []
                for r in f.itertuples(index=False):
                    start = time.perf_counter()
                    status, why, nodes, _, _, nm, visited, fwd, rev = search.solve(sent.value, r.s, r.t, r.algorithm)
                    took = (time.perf_counter() - start) * 1000
                    out.append((r.name, r.algorithm, r.mode, r.from_locode, r.to_locode, r.iteration, status == "Success", took, visited, fwd, rev, nodes, nm, why))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in SEARCHED.split(", ")])

        if self.csr is None:
            searched = self._search_by_joins(runs, pairs.sparkSession.range(1).select(n).first()[0])
        else:
            searched = runs.mapInPandas(run, SEARCHED)
        found = materialize(searched.withColumn("path_id", F.xxhash64("name", "algorithm", "mode", "from_locode", "to_locode", "iteration")), "searched")
        drawn = self.draw(found.where("success"), timed=True).select("path_id", "shape_ms")
        total = F.when(F.col("success"), F.col("search_ms") + F.coalesce("shape_ms", F.lit(0.0))).otherwise(F.col("search_ms"))
        count = F.when(F.col("success"), F.size("path_nodes").cast("double"))
        made = found.join(drawn, "path_id", "left").withColumns({"total_ms": total, "node_count": count})
        return made.select(*[c.split()[0] for c in RUNS.split(", ")])

    def benchmark(self, pairs: DataFrame, iterations: int | None = None, default_iterations: int = 5) -> DataFrame:
        return rollup(materialize(self.benchmark_runs(pairs, iterations, default_iterations), "runs"))

    def benchmark_suite(self, iterations: int | None = None, presets: list[tuple[str, str, str]] = PRESETS) -> DataFrame:
        pairs = self.nodes.sparkSession.createDataFrame(presets, "name string, from_locode string, to_locode string")
        return self.benchmark(pairs, iterations, 1)


SEARCHED = (
    "name string, algorithm string, mode string, from_locode string, to_locode string, iteration int, success boolean, search_ms double, "
    "visited double, fwd_visited double, rev_visited double, path_nodes array<int>, distance_nm double, failure string"
)
RUNS = (
    "name string, algorithm string, mode string, from_locode string, to_locode string, iteration int, success boolean, search_ms double, "
    "total_ms double, visited double, fwd_visited double, rev_visited double, node_count double, distance_nm double, failure string"
)


def average(value: Column) -> Column:
    """Average of an aggregate's rows, 0 of nothing."""
    return F.coalesce(F.avg(value), F.lit(0.0))


def p95(expression: str) -> Column:
    """Nearest-rank 95th percentile of an aggregate's rows, 0 of nothing."""
    return F.coalesce(F.expr(f"percentile_disc(0.95) within group (order by {expression})"), F.lit(0.0))


def rollup(runs: DataFrame) -> DataFrame:
    """Counts, averages, 95th percentiles and last values by scenario."""
    avg = lambda c, name: average(F.when(F.col("success"), F.col(c))).alias(f"avg_{name}")
    top = lambda c, name: p95(f"case when success then {c} end").alias(f"p95_{name}")
    last = lambda c, name: F.max_by(F.col(c), F.when(F.col("success"), F.col("iteration"))).alias(f"last_{name}")
    return runs.groupBy("name", "algorithm", "mode", "from_locode", "to_locode").agg(
        F.count("*").alias("iterations"),
        F.count(F.when(F.col("success"), 1)).alias("success_count"),
        F.count(F.when(~F.col("success"), 1)).alias("failure_count"),
        avg("search_ms", "search_ms"), top("search_ms", "search_ms"), avg("total_ms", "total_ms"), top("total_ms", "total_ms"),
        avg("visited", "visited"), top("visited", "visited"), avg("fwd_visited", "fwd_visited"), avg("rev_visited", "rev_visited"),
        last("node_count", "node_count"), last("distance_nm", "distance_nm"), last("visited", "visited"),
        F.max_by("failure", F.when(~F.col("success"), F.col("iteration"))).alias("last_failure"),
    )
