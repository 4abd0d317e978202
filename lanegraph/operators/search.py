"""Least-cost search: batches of requests over a broadcast network, or frontier joins beyond its bound.

The network is broadcast as offset arrays while it has at most ``MAX_BROADCAST_EDGES`` edges (24 bytes
each, and about 100 more in each worker that searches with a heap, which reads lists); requests are dealt
over ``spread`` tasks, those of one source next to each other, so that a task searches from it once. A
larger network stays a table. Its linked groups of at most ``MAX_TASK_EDGES`` edges meet their requests in tasks, which
search them in the same way; in larger groups all requests advance together towards their targets, a join of the released
nodes with the edges per round (``frontier``). All ways have both algorithms and give the same costs, and Dijkstra's
count of settled nodes; of equal paths the one with the smaller last edge id is kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanegraph.functions.geo import EARTH_RADIUS_NM, haversine_nm, haversine_py
from lanegraph.operators import frontier
from lanegraph.operators.network import adjacency, landmarks, linked_groups, min_cost_rate
from lanegraph.shared import materialize, remove_table, spread

MAX_BROADCAST_EDGES = 20_000_000
#: A linked group of at most so many edges is searched whole by a task (about 250 bytes an edge with a heap), which answers
#: so many of its requests, or finds the distances from so many sources.
MAX_TASK_EDGES = 2_000_000
TASK_REQUESTS, TASK_SOURCES = 1024, 8
#: Of a bare request; the service has a default of its own.
DEFAULT_ALGORITHM = "dijkstra"
INF = float("inf")
#: Cells of the table of costs that a task of ``expand_costs`` fills at a time.
STRIP_CELLS = 1 << 24


class Csr:
    """Edges grouped by source, and by target, with coordinates; the unit that is broadcast."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, cost: np.ndarray, edge_id: np.ndarray, n: int, lat: np.ndarray | None = None, lon: np.ndarray | None = None):
        self.n = n
        self.lat, self.lon = lat, lon
        self.forward = self._grouped(src, dst, cost, edge_id)
        self.backward = self._grouped(dst, src, cost, edge_id)
        self.landmark_ids: list[int] = []
        self.from_landmark: list[np.ndarray] = []
        self.to_landmark: list[np.ndarray] = []
        self.rate = 0.0
        self._lists: dict[bool, tuple] = {}

    def _grouped(self, key, other, cost, edge_id):
        order = np.lexsort((edge_id, cost, key))  # cheap edges first, so that a search can stop within a node
        start = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=self.n))])
        return start, other[order].astype(np.int32), cost[order].astype(np.float32), edge_id[order].astype(np.int32)

    def lists(self, reverse: bool) -> tuple:
        """Plain lists, which heap loops read faster than arrays; made once per worker."""
        if reverse not in self._lists:
            start, to, cost, edge = self.backward if reverse else self.forward
            self._lists[reverse] = (start.tolist(), to.tolist(), cost.astype(np.float64).tolist(), edge.tolist())
        return self._lists[reverse]

    def __getstate__(self):
        return {**self.__dict__, "_lists": {}}


def build_csr(nodes: DataFrame, edges: DataFrame) -> Csr:
    """Collect a network that was found to be within the bound; node ids are dense."""
    e = edges.select(F.col("src").cast("int"), F.col("dst").cast("int"), F.col("cost").cast("float"), F.col("edge_id").cast("int")).toArrow()
    v = nodes.select(F.col("node_id").cast("int"), F.col("lat").cast("double"), F.col("lon").cast("double")).toArrow()
    ids = v["node_id"].to_numpy()
    n = int(ids.max()) + 1 if len(ids) else 0
    lat, lon = np.zeros(n), np.zeros(n)
    lat[ids], lon[ids] = v["lat"].to_numpy(), v["lon"].to_numpy()
    return Csr(*(e[c].to_numpy() for c in ("src", "dst", "cost", "edge_id")), n, lat, lon)


def tree(csr: Csr, source: int, reverse: bool = False, target: int = -1) -> tuple[dict[int, float], dict[int, tuple[int, int]], dict[int, int]]:
    """Heap search from ``source``: distances, last step (node before, edge) by node, and the rank at which each node was settled."""
    start, to, cost, edge = csr.lists(reverse)
    dist = {source: 0.0}
    last: dict[int, tuple[int, int]] = {}
    done: dict[int, int] = {}
    heap = [(0.0, source)]
    while heap:
        d, v = heapq.heappop(heap)
        if v in done:
            continue
        done[v] = len(done) + 1
        if v == target:
            break
        for i in range(start[v], start[v + 1]):
            w, nd = to[i], d + cost[i]
            old = dist.get(w, INF)
            if nd < old:
                dist[w], last[w] = nd, (v, edge[i])
                heapq.heappush(heap, (nd, w))
            elif nd == old and w != source and w not in done and edge[i] < last[w][1]:
                last[w] = (v, edge[i])
    return dist, last, done


def all_distances(csr: Csr, source: int, reverse: bool = False) -> np.ndarray:
    """Distances from ``source`` to every node (infinite where there is no path), relaxed in whole arrays.

    Nodes whose distance is below a moving limit are relaxed together; the limit grows by a few mean edge costs.
    """
    start, to, cost, _ = csr.backward if reverse else csr.forward
    dist = np.full(csr.n, INF)
    dist[source] = 0.0
    step = 4.0 * float(cost.mean()) + 1e-9 if len(cost) else 1.0
    waiting = np.array([source])
    limit = step
    while len(waiting):
        ready = dist[waiting] < limit
        now, waiting = waiting[ready], waiting[~ready]
        while len(now):
            count = start[now + 1] - start[now]
            at = np.repeat(start[now] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            there, far = to[at], np.repeat(dist[now], count) + cost[at]
            better = far < dist[there]
            there, far = there[better], far[better]
            np.minimum.at(dist, there, far)
            moved = np.unique(there)
            soon = dist[moved] < limit
            now, later = moved[soon], moved[~soon]
            if len(later):
                waiting = np.concatenate([waiting, later])
        if len(waiting):
            waiting = np.unique(waiting)
            waiting = waiting[dist[waiting] >= limit]
            limit = float(dist[waiting].min()) + step if len(waiting) else limit
    return dist


def trail(last: dict[int, tuple[int, int]], source: int, node: int) -> tuple[list[int], list[int]]:
    """Nodes from source to node and the edges between them."""
    nodes, edges = [node], []
    while node != source:
        node, e = last[node]
        nodes.append(node)
        edges.append(e)
    return nodes[::-1], edges[::-1]


def landmark_distances(csr: Csr, landmark: int, reverse: bool) -> np.ndarray:
    out = all_distances(csr, landmark, reverse)
    return np.where(out < INF, out, np.nan)  # no path: drops out of every maximum


def add_landmarks(csr: Csr, ids: list[int], rate: float) -> Csr:
    """Distance tables from and to each landmark, in double precision, for lower bounds."""
    csr.landmark_ids, csr.rate = ids, rate
    for v in ids:
        csr.from_landmark.append(landmark_distances(csr, v, False))
        csr.to_landmark.append(landmark_distances(csr, v, True))
    return csr


def bounds(csr: Csr, v: int, into: bool, at: np.ndarray | None = None) -> np.ndarray:
    """Bounds on the costs from the nodes ``at`` (all of them) to v (``into``), or from v to them: landmarks, else the cheapest rate along the great circle."""
    at = np.arange(csr.n) if at is None else at
    best = np.zeros(len(at))
    for near, far in zip(csr.from_landmark, csr.to_landmark):
        a, b = near[at], far[at]
        best = np.fmax(best, near[v] - a if into else a - near[v])
        best = np.fmax(best, b - far[v] if into else far[v] - b)
    bare = np.flatnonzero(best <= 0) if csr.rate > 0 and csr.lat is not None else ()
    if len(bare):
        lat, lon, lat0, lon0 = np.radians(csr.lat[at[bare]]), np.radians(csr.lon[at[bare]]), np.radians(csr.lat[v]), np.radians(csr.lon[v])
        a = np.sin((lat - lat0) / 2) ** 2 + np.cos(lat) * np.cos(lat0) * np.sin((lon - lon0) / 2) ** 2
        best[bare] = csr.rate * 2 * EARTH_RADIUS_NM * np.arcsin(np.sqrt(np.minimum(1.0, a)))
    return best * (1 - 1e-12)


def lower_bound(csr: Csr, s: int, t: int) -> float:
    return float(bounds(csr, t, True, np.array([s]))[0])


class Potential(dict):
    """Balanced potentials of a pair (s, t) by node. Where a node's is missing, those of its neighbours on either side are found with it."""

    def __init__(self, csr: Csr, s: int, t: int):
        super().__init__()
        self.csr, self.s, self.t = csr, s, t
        self.total = lower_bound(csr, s, t)

    def __missing__(self, v: int) -> float:
        near = [to[start[v] : start[v + 1]] for start, to, _, _ in (self.csr.forward, self.csr.backward)]
        at = np.unique(np.concatenate([np.array([v]), *near]))
        self.update(zip(at.tolist(), (0.5 * (bounds(self.csr, self.t, True, at) - bounds(self.csr, self.s, False, at) + self.total)).tolist()))
        return self[v]


def two_sided(csr: Csr, s: int, t: int) -> tuple[float, list[int], list[int], int, int] | None:
    """Bidirectional A* with balanced potentials: cost, nodes, edges, nodes settled on either side; None without a path."""
    potential = Potential(csr, s, t)
    total = potential.total
    sides = []
    for root, forward in ((s, True), (t, False)):
        h = potential[root] if forward else total - potential[root]
        sides.append({"dist": {root: 0.0}, "last": {}, "heap": [(h, root)], "done": set(), "adj": csr.lists(not forward), "forward": forward})
    best, meet = INF, -1
    while sides[0]["heap"] and sides[1]["heap"]:
        keys = [side["heap"][0][0] for side in sides]
        if keys[0] + keys[1] >= best + total - 1e-9:
            break
        sizes = [len(side["heap"]) for side in sides]
        k = 0 if (sizes[0], keys[0]) <= (sizes[1], keys[1]) else 1
        side, other = sides[k], sides[1 - k]
        _, v = heapq.heappop(side["heap"])
        if v in side["done"]:
            continue
        side["done"].add(v)
        dist, last, forward, far = side["dist"], side["last"], side["forward"], other["dist"]
        dv = dist[v]
        if v in far and dv + far[v] < best:
            best, meet = dv + far[v], v
        start, to, cost, edge = side["adj"]
        for i in range(start[v], start[v + 1]):
            w, nd = to[i], dv + cost[i]
            if nd >= best:  # nor can any dearer edge be on a better path
                break
            if nd < dist.get(w, INF):
                dist[w], last[w] = nd, (v, edge[i])
                side["done"].discard(w)  # bounds that differ by node may need a node again
                heapq.heappush(side["heap"], (nd + (potential[w] if forward else total - potential[w]), w))
                if w in far and nd + far[w] < best:
                    best, meet = nd + far[w], w
    if meet < 0:
        return None
    n1, e1 = trail(sides[0]["last"], s, meet)
    n2, e2 = trail(sides[1]["last"], t, meet)
    return best, n1 + n2[::-1][1:], e1 + e2[::-1], len(sides[0]["done"]), len(sides[1]["done"])


RESULT = (
    "request_id long, status string, failure_reason string, path_nodes array<int>, path_edges array<int>, total_cost double, "
    "total_distance_nm double, visited int, fwd_visited int, rev_visited int"
)


def solve(csr: Csr, s: int, t: int, algorithm: str, known: dict | None = None) -> tuple:
    """One request's result, in the order of RESULT without the id. ``known`` keeps the last source's whole tree for requests that share it."""
    fail = lambda status, why, visited=0: (status, why, None, None, None, None, visited, None, None)
    for name, v in (("from", s), ("to", t)):
        if v is None or not 0 <= v < csr.n:
            return fail("InvalidNode", f"{name} node is not in the network")
    if s == t:
        return ("Success", None, [s], [], 0.0, 0.0, 0, None, None)
    if algorithm == "bidirectional-a-star":
        found = two_sided(csr, s, t)
        if found is None:
            return fail("NoPath", "no path between the nodes")
        cost, nodes, edges, a, b = found
        counts = (a + b, a, b)
    else:
        if known is None:
            dist, last, done = tree(csr, s, target=t)
        else:
            if s not in known:
                known.clear()
                known[s] = tree(csr, s)
            dist, last, done = known[s]
        if t not in dist:
            return fail("NoPath", "no path between the nodes", len(done))
        nodes, edges = trail(last, s, t)
        cost, counts = dist[t], (done[t], None, None)
    nm = sum(haversine_py(csr.lat[a], csr.lon[a], csr.lat[b], csr.lon[b]) for a, b in zip(nodes, nodes[1:]))
    return ("Success", None, nodes, edges, cost, nm, *counts)


KINDS = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]


def solve_all(csr: Csr, ids: list, s: list, t: list, how: list, known: dict) -> Iterator[pa.RecordBatch]:
    """RESULT of requests that are sorted by source, some at a time."""
    shared = [x == y for x, y in zip(s, s[1:])]
    several = [x or y for x, y in zip([False, *shared], [*shared, False])]
    for lo in range(0, len(ids), 512):
        hi = lo + 512
        rows = [(i, *solve(csr, x, y, a, known if m else None)) for i, x, y, a, m in zip(ids[lo:hi], s[lo:hi], t[lo:hi], how[lo:hi], several[lo:hi])]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], names=[p.split()[0] for p in RESULT.split(", ")])


def fits(edges: DataFrame, limit: int = MAX_BROADCAST_EDGES) -> bool:
    """Whether the network is small enough to be broadcast."""
    return edges.count() <= limit


def load_network(nodes: DataFrame, edges: DataFrame, with_landmarks: bool = False) -> Csr:
    """The network to broadcast, and perhaps its landmark tables, each made by a task of its own and as long as the list of nodes."""
    csr = build_csr(nodes, edges)
    if not with_landmarks:
        return csr
    spark = nodes.sparkSession
    ids = [r["node_id"] for r in landmarks(nodes).orderBy("place").collect()]
    csr.landmark_ids, csr.rate = ids, min_cost_rate(edges, nodes).first()[0]
    if not ids:
        return csr
    sent = spark.sparkContext.broadcast(csr)

    def run(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                dist = landmark_distances(sent.value, ids[i // 2], i % 2 == 1)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([dist.tobytes()], pa.binary())], names=["i", "dist"])

    n = 2 * len(ids)
    for row in sorted(spark.range(0, n, 1, n).mapInArrow(run, "i long, dist binary").collect()):
        (csr.to_landmark if row["i"] % 2 else csr.from_landmark).append(np.frombuffer(row["dist"]))
    return csr


def route_requests(requests: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = MAX_BROADCAST_EDGES, csr: Csr | None = None) -> DataFrame:
    """RESULT of every request (request_id, from_node, to_node, and perhaps algorithm: ``DEFAULT_ALGORITHM`` where it is missing or null)."""
    asked = F.col("algorithm") if "algorithm" in requests.columns else F.lit(None).cast("string")
    requests = requests.withColumn("algorithm", F.coalesce(asked, F.lit(DEFAULT_ALGORITHM)))
    if csr is None and not fits(edges, limit):
        return route_by_groups(requests, nodes, edges)
    if csr is None:
        wants = requests.where(F.col("algorithm") == "bidirectional-a-star").limit(1).count() > 0
        csr = load_network(nodes, edges, wants)
    sent = requests.sparkSession.sparkContext.broadcast(csr)
    dealt = requests.select(F.col("request_id").cast("long"), F.col("from_node").cast("int"), F.col("to_node").cast("int"), "algorithm")
    salt = F.pmod(F.xxhash64("request_id"), F.lit(8))  # a source that all requests share is searched by eight tasks at most
    dealt = dealt.repartition(spread(requests.sparkSession), F.when(F.col("algorithm") == "dijkstra", F.col("from_node")), F.when(F.col("algorithm") == "dijkstra", salt).otherwise(F.xxhash64("request_id")))
    dealt = dealt.sortWithinPartitions("from_node", "request_id")

    def run(batches) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            yield from solve_all(sent.value, *(b.column(i).to_pylist() for i in range(4)), known)

    return dealt.mapInArrow(run, RESULT)


def groups_of(edges: DataFrame, limit: int = MAX_TASK_EDGES) -> DataFrame:
    """node, group, small: the linked groups, and whether one has at most ``limit`` edges. Written once."""
    group = materialize(linked_groups(edges).where("node is not null"), "groups")
    degrees = edges.groupBy(F.col("src").cast("int").alias("node")).agg(F.count("*").alias("n"))  # the edges themselves need not move
    sizes = degrees.join(group, "node").groupBy("group").agg((F.sum("n") <= limit).alias("small"))
    return materialize(group.join(sizes, "group").select("node", "group", "small"), "groups")


def _in_groups(rows: DataFrame, at_most: int, nodes: DataFrame, edges: DataFrame, groups: DataFrame, solved, schema: str) -> DataFrame:
    """``solved(csr, ids, part)`` of ``rows`` with a ``group``, cut into parts of about ``at_most`` rows of one group.

    A part and the edges of its group, and no others, meet in a task. ``csr`` numbers the group's nodes in their order, and one
    more without edges stands for all others; ``ids`` has what they are.
    """
    parts = rows.groupBy("group").agg(F.ceil(F.count("*") / at_most).cast("int").alias("parts"))
    cut = rows.join(parts, "group").withColumn("part", F.pmod(F.xxhash64(*rows.columns), F.col("parts")).cast("int")).drop("parts")
    wanted = groups.join(parts, "group").select("group", "node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    none = lambda kind: F.lit(None).cast(kind)
    step = edges.select(F.col("src").cast("int").alias("node"), F.col("dst").cast("int").alias("dst"), F.col("cost").cast("float").alias("cost"), F.col("edge_id").cast("int").alias("edge_id"))
    step = step.where("cost is not null").join(wanted, "node").select("group", "part", "node", "dst", "cost", "edge_id", none("double").alias("lat"), none("double").alias("lon"))
    place = nodes.select(F.col("node_id").cast("int").alias("node"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    place = place.join(wanted, "node").select("group", "part", "node", none("int").alias("dst"), none("float").alias("cost"), none("int").alias("edge_id"), "lat", "lon")
    tasks = spread(rows.sparkSession)
    mine, theirs = (x.repartition(tasks, "group", "part").groupBy("group", "part") for x in (cut, step.unionByName(place)))

    def run(part: pa.Table, network: pa.Table) -> pa.Table:
        held = network.filter(pc.is_valid(network["dst"])), network.filter(pc.is_null(network["dst"]))
        src, dst, cost, edge = (held[0][c].to_numpy() for c in ("node", "dst", "cost", "edge_id"))
        ids = np.unique(np.concatenate([src, dst]))
        lat, lon = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
        at = np.searchsorted(ids, held[1]["node"].to_numpy())
        lat[at], lon[at] = held[1]["lat"].to_numpy(), held[1]["lon"].to_numpy()
        return solved(Csr(np.searchsorted(ids, src), np.searchsorted(ids, dst), cost, edge, len(ids) + 1, lat, lon), ids, part)

    return mine.cogroup(theirs).applyInArrow(run, schema)


def distances(sources: DataFrame, nodes: DataFrame, edges: DataFrame, reverse: bool = False, limit: int = MAX_BROADCAST_EDGES, groups: DataFrame | None = None) -> DataFrame:
    """source, node_id, distance of every node that each source reaches (or, reversed, that reaches it). ``groups``: what ``groups_of`` gave before."""
    if groups is not None or not fits(edges, limit):
        return distances_by_groups(sources, nodes, edges, reverse, groups)
    sent = sources.sparkSession.sparkContext.broadcast(build_csr(nodes, edges))

    def run(batches):
        for b in batches:
            for v in b.column(0).to_pylist():
                if v is None or not 0 <= v < sent.value.n:
                    continue
                dist = all_distances(sent.value, v, reverse)
                found = np.flatnonzero(dist < INF)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), v, np.int32)), pa.array(found.astype(np.int32)), pa.array(dist[found])], names=["source", "node_id", "distance"])

    dealt = sources.select(F.col("source").cast("int")).distinct().repartition(spread(sources.sparkSession), "source")
    return dealt.mapInArrow(run, "source int, node_id int, distance double")


def distances_by_groups(sources: DataFrame, nodes: DataFrame, edges: DataFrame, reverse: bool = False, groups: DataFrame | None = None) -> DataFrame:
    """The same on a network that is not broadcast: small linked groups in tasks, the others by ``frontier_distances``."""
    groups = groups_of(edges) if groups is None else groups
    asked = materialize(sources.select(F.col("source").cast("int").alias("source")).distinct().join(groups.withColumnRenamed("node", "source"), "source", "left"), "sources")
    names = ["source", "node_id", "distance"]

    def solved(csr: Csr, ids: np.ndarray, part: pa.Table) -> pa.Table:
        made = []
        for v in part["source"].to_pylist():
            dist = all_distances(csr, int(np.searchsorted(ids, v)), reverse)
            found = np.flatnonzero(dist < INF)
            made.append(pa.table([pa.array(np.full(len(found), v, np.int32)), pa.array(ids[found].astype(np.int32)), pa.array(dist[found])], names=names))
        return pa.concat_tables(made) if made else pa.table([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.float64())], names=names)

    found = _in_groups(asked.where("small").drop("small"), TASK_SOURCES, nodes, edges, groups, solved, "source int, node_id int, distance double")
    rest = asked.where("small is null or not small").select("source")
    return found.unionByName(frontier_distances(rest, edges, reverse).select(*names)) if rest.limit(1).count() else found


def expand(front: DataFrame, edges: DataFrame, reverse: bool = False) -> DataFrame:
    """source, node_id and the best step (distance, last_edge, before) over one edge from the nodes of ``front`` (source, at, so_far)."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = edges.select(F.col(a).cast("int").alias("at"), F.col(b).cast("int").alias("node_id"), F.col("cost").cast("double").alias("cost"), F.col("edge_id").cast("int").alias("edge_id"))
    best = F.min(F.struct((F.col("so_far") + F.col("cost")).alias("distance"), F.col("edge_id").alias("last_edge"), F.col("at").alias("before")))
    return front.join(step, "at").groupBy("source", "node_id").agg(best.alias("new"))


def _block_costs(front: pa.Table, steps: pa.Table):
    """Batches of source, node_id, distance from one block's front (source, at, so_far) and steps (at, node_id, cost), neither with repeats."""
    f, e = ({c: t[c].to_numpy() for c in t.column_names if not c.endswith("block")} for t in (front.sort_by("at"), steps.sort_by("at")))
    sources, row = np.unique(f["source"], return_inverse=True)
    nodes, col = np.unique(e["node_id"], return_inverse=True)
    at = np.intersect1d(f["at"], e["at"])
    spans = list(zip(*(np.searchsorted(x["at"], at, side) for x in (f, e) for side in ("left", "right"))))
    height = max(1, STRIP_CELLS // max(1, len(nodes)))
    for lo in range(0, len(sources), height):
        best = np.full((min(height, len(sources) - lo), len(nodes)), INF)
        for f0, f1, e0, e1 in spans:
            mine = np.arange(f0, f1)[(row[f0:f1] >= lo) & (row[f0:f1] < lo + height)]
            cells = np.ix_(row[mine] - lo, col[e0:e1])
            best[cells] = np.minimum(best[cells], f["so_far"][mine][:, None] + e["cost"][e0:e1])
        i, j = np.nonzero(best < INF)
        yield pa.RecordBatch.from_arrays([pa.array(sources[lo + i].astype(np.int32)), pa.array(nodes[j].astype(np.int32)), pa.array(best[i, j])], names=["source", "node_id", "distance"])


def expand_costs(front: DataFrame, edges: DataFrame, block: int = 1024) -> DataFrame:
    """source, node_id, distance: the least cost over one edge from the nodes of ``front`` (source, at, so_far), for fronts of many sources.

    Sources are cut into blocks of ids. An edge goes to the blocks whose fronts hold its start, so a block is reduced in the
    task that has it: the costs of all ways, many more than the edges, are neither shuffled nor sorted.
    """
    rows = front.where("so_far is not null").select(F.floor(F.col("source") / block).cast("int").alias("block"), F.col("source").cast("int").alias("source"), F.col("at").cast("int").alias("at"), F.col("so_far").cast("double").alias("so_far"))
    wanted = rows.select("block", "at").distinct().toDF("for_block", "at")
    tasks = spread(front.sparkSession)
    # Each side is dealt by its block once, and repeats go where they meet.
    best = rows.repartition(tasks, "block").groupBy("block", "source", "at").agg(F.min("so_far").alias("so_far"))
    step = edges.where("cost is not null").select(F.col("src").cast("int").alias("at"), F.col("dst").cast("int").alias("node_id"), F.col("cost").cast("double").alias("cost")).join(wanted, "at")
    step = step.repartition(tasks, "for_block").groupBy("for_block", "at", "node_id").agg(F.min("cost").alias("cost"))
    mine, theirs = best.groupBy("block"), step.groupBy("for_block")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = list(_block_costs(left, right)) if len(left) and len(right) else []
        return pa.Table.from_batches(made, schema=pa.schema([("source", pa.int32()), ("node_id", pa.int32()), ("distance", pa.float64())]))

    return mine.cogroup(theirs).applyInArrow(run, "source int, node_id int, distance double")


def frontier_distances(sources: DataFrame, edges: DataFrame, reverse: bool = False) -> DataFrame:
    """The same by rounds of joins, with last_edge and before (the previous node): nothing is broadcast by this code.

    A round relaxes the edges of the nodes that improved in the last one. Tables go to the shared folder,
    so lineage stays short and a lost executor repeats one round's tasks; a round's table is dropped once the next is written.
    """
    best = sources.select(F.col("source").cast("int").alias("source")).distinct()
    best = best.select("source", F.col("source").alias("node_id"), F.lit(0.0).alias("distance"), F.lit(-1).alias("last_edge"), F.lit(-1).alias("before"), F.lit(True).alias("fresh"))
    best = materialize(best, "frontier")
    while True:
        front = best.where("fresh").select("source", F.col("node_id").alias("at"), F.col("distance").alias("so_far"))
        both = best.join(expand(front, edges, reverse), ["source", "node_id"], "full_outer")
        better = F.coalesce(F.col("new.distance") < F.col("distance"), F.col("distance").isNull())
        tie = F.coalesce((F.col("new.distance") == F.col("distance")) & (F.col("new.last_edge") < F.col("last_edge")) & (F.col("last_edge") >= 0), F.lit(False))
        take = lambda c: F.when(better | tie, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c)
        before, best = best, materialize(both.select("source", "node_id", take("distance"), take("last_edge"), take("before"), better.alias("fresh")), "frontier")
        remove_table(before)
        if not best.where("fresh").limit(1).count():
            return best.drop("fresh")


def trails(ends: DataFrame, reach: DataFrame) -> DataFrame:
    """request_id, nodes, edges of the paths to ``ends`` (request_id, source, node_id) in the trees ``reach``.

    By doubling: every node learns the one 1, 2, 4, ... steps before it, and a path's set of known nodes is carried on by
    each of these jumps in turn, so a path of n nodes takes about 2 log2(n) joins.
    """
    jump = materialize(reach.where("before >= 0").select("source", "node_id", F.col("before").alias("to")), "jump")
    jumps = [jump]
    while jump.limit(1).count():
        further = jump.toDF("source", "mid", "far")
        jump = materialize(jump.join(further, (jump["source"] == further["source"]) & (jump["to"] == further["mid"])).select(jump["source"], "node_id", F.col("far").alias("to")), "jump")
        jumps.append(jump)
    on = ends.select("request_id", "source", "node_id", F.lit(0).cast("long").alias("back"))
    for k, step in enumerate(jumps):
        moved = on.join(step, ["source", "node_id"]).select("request_id", "source", F.col("to").alias("node_id"), (F.col("back") + (1 << k)).alias("back"))
        before, on = on, materialize(on.unionByName(moved), "trail")
        if k:
            remove_table(before)
    for step in jumps:
        remove_table(step)
    at = on.join(reach.select("source", "node_id", "last_edge"), ["source", "node_id"])
    row = F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("o"), "node_id", "last_edge")))
    rows = at.groupBy("request_id").agg(row.alias("r"))
    return rows.select("request_id", F.transform("r", lambda x: x["node_id"]).alias("nodes"), F.transform(F.filter("r", lambda x: x["last_edge"] >= 0), lambda x: x["last_edge"]).alias("edges"))


def route_by_groups(requests: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = MAX_TASK_EDGES) -> DataFrame:
    """RESULT of every request on a network that is not broadcast.

    Requests that stay in a linked group of at most ``limit`` edges meet the group in a task, with landmarks of its own; the
    others go by ``route_by_frontier``, which settles those without a search that need none.
    """
    groups = groups_of(edges, limit)
    two = F.col("algorithm") == "bidirectional-a-star"
    r = requests.select(F.col("request_id").cast("long"), F.col("from_node").cast("int"), F.col("to_node").cast("int"), "algorithm")
    for side, node in (("s", "from_node"), ("t", "to_node")):
        place = nodes.select(F.col("node_id").cast("int").alias("node")).join(groups, "node", "left").select(F.col("node").alias(node), F.col("group").alias(f"{side}_group"), F.coalesce("small", F.lit(False)).alias(f"{side}_small"))
        r = r.join(place, node, "left")
    here = F.col("s_small") & F.col("t_small").isNotNull() & (F.col("from_node") != F.col("to_node")) & (~two | (F.col("s_group") == F.col("t_group")))
    r = materialize(r.withColumn("here", F.coalesce(here, F.lit(False))), "placed")
    names = [p.split()[0] for p in RESULT.split(", ")]

    def solved(csr: Csr, ids: np.ndarray, part: pa.Table) -> pa.Table:
        part = part.sort_by("from_node")
        how = part["algorithm"].to_pylist()
        if "bidirectional-a-star" in how:
            marks = [int(f(c[: len(ids)])) for c in (csr.lon, csr.lat) for f in (np.argmin, np.argmax)]
            add_landmarks(csr, list(dict.fromkeys(marks)), 0.0)
        at = {v: i for i, v in enumerate(ids.tolist())}
        ends = ([at.get(v, len(ids)) for v in part[c].to_pylist()] for c in ("from_node", "to_node"))
        made = pa.Table.from_batches(solve_all(csr, part["request_id"].to_pylist(), *ends, how, {}), schema=pa.schema(list(zip(names, KINDS))))
        walks = [None if w is None else ids[w].tolist() for w in made["path_nodes"].to_pylist()]
        return made.set_column(3, "path_nodes", pa.array(walks, KINDS[3]))

    near = r.where("here").select("request_id", "from_node", "to_node", "algorithm", F.col("s_group").alias("group"))
    found = _in_groups(near, TASK_REQUESTS, nodes, edges, groups, solved, RESULT)
    return found.unionByName(route_by_frontier(r.where("not here"), nodes, edges, groups=groups))


def route_by_frontier(requests: DataFrame, nodes: DataFrame, edges: DataFrame, table: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """RESULT of every request by goal-directed rounds of joins (``frontier``), all at once, both algorithms as asked.

    ``table`` is a ``landmark_table`` and ``groups`` what ``groups_of`` gave before; they are made here if pairs need them.

    ``visited`` of Dijkstra is the count of nodes that it would settle; bidirectional A* counts the nodes released on
    either side, a node again if its label improved later.
    """
    known = nodes.select(F.col("node_id").alias("n"))
    r = requests.select(F.col("request_id").cast("long"), F.col("from_node").cast("int"), F.col("to_node").cast("int"), F.coalesce(F.col("algorithm") == "bidirectional-a-star", F.lit(False)).alias("two"))
    r = r.join(known.select(F.col("n").alias("from_node"), F.lit(True).alias("has_from")), "from_node", "left")
    r = r.join(known.select(F.col("n").alias("to_node"), F.lit(True).alias("has_to")), "to_node", "left")
    # A tree is numbered by its source, a pair by both nodes.
    unit = F.when(F.col("two"), (F.col("from_node") + F.lit(1)).cast("long") * F.lit(1 << 31) + F.col("to_node")).otherwise(F.col("from_node").cast("long"))
    r = materialize(r.withColumn("unit", unit), "requests")
    ok = r.where("has_from and has_to and from_node <> to_node")
    if ok.where("two").limit(1).count():
        # Pairs that no edges link, in whatever direction, are settled without a search.
        group = linked_groups(edges).where("node is not null") if groups is None else groups.select("node", "group")
        linked = ok.where("two").join(group.toDF("from_node", "__s"), "from_node").join(group.toDF("to_node", "__t"), "to_node").where("__s = __t").drop("__s", "__t")
        ok = ok.where("not two").unionByName(materialize(linked.select(*ok.columns), "linked"))
    units = ok.select("unit", F.col("from_node").alias("s"), F.when(F.col("two"), F.col("to_node")).alias("t")).distinct()
    marks = None
    if ok.where("two").limit(1).count():
        marks = materialize(frontier.landmark_columns(nodes, table if table is not None else landmark_table(nodes, edges, 0)), "marks")
    mean = edges.agg(F.avg("cost")).first()[0] or 0.0
    labels, came = frontier.grow(units, ok.where("not two").select("unit", F.col("to_node").alias("node")).distinct(), edges, marks, 4.0 * mean + 1e-9)
    # Trees: the target's own label. Pairs: the node where the two sides meet for least.
    single = ok.where("not two").select("request_id", "unit", F.col("to_node").alias("node")).join(labels.where("f is not null"), ["unit", "node"])
    meets = labels.where("f is not null and b is not null").groupBy("unit").agg(F.min(F.struct((F.col("f.g") + F.col("b.g")).alias("g"), "node")).alias("m"))
    pair = ok.where("two").select("request_id", "unit").join(meets, "unit")
    ends = single.select("request_id", "unit", "node", F.col("f.g").alias("cost")).unionByName(pair.select("request_id", "unit", F.col("m.node").alias("node"), F.col("m.g").alias("cost")))
    same = r.where("has_from and has_to and from_node = to_node").select("request_id", F.array("from_node").alias("nodes"), F.array().cast("array<int>").alias("edges"), F.lit(0.0).alias("cost"))
    ends = materialize(ends, "ends")
    reach = lambda c: labels.where(f"{c} is not null").select(F.col("unit").alias("source"), F.col("node").alias("node_id"), F.col(f"{c}.edge").alias("last_edge"), F.col(f"{c}.before").alias("before"))
    asked = ends.select("request_id", F.col("unit").alias("source"), F.col("node").alias("node_id"))
    walk = trails(asked, reach("f"))
    if marks is not None:
        back = trails(asked.join(pair.select("request_id"), "request_id", "left_semi"), reach("b")).withColumnsRenamed({"nodes": "n2", "edges": "e2"})
        walk = walk.join(back, "request_id", "left").select(
            "request_id",
            F.when(F.col("n2").isNull(), F.col("nodes")).otherwise(F.concat("nodes", F.slice(F.reverse("n2"), F.lit(2), F.size("n2")))).alias("nodes"),
            F.when(F.col("e2").isNull(), F.col("edges")).otherwise(F.concat("edges", F.reverse("e2"))).alias("edges"),
        )
    walk = materialize(walk.join(ends.select("request_id", "cost"), "request_id").unionByName(same), "walks")
    nm = path_length(walk.select(F.col("request_id").alias("path_id"), F.col("nodes").alias("path_nodes")), nodes).select(F.col("path_id").alias("request_id"), "distance_nm")
    place = frontier.ranks(single, labels).withColumnRenamed("node", "to_node")
    sizes = labels.where("f is not null").groupBy("unit").agg(F.count("*").cast("int").alias("all"))
    out = r.join(walk.join(nm, "request_id"), "request_id", "left").join(place, ["unit", "to_node"], "left").join(sizes, "unit", "left").join(came.select("unit", "released_f", "released_b"), "unit", "left")
    bad = F.col("has_from").isNull() | F.col("has_to").isNull()
    lost = F.col("nodes").isNull()
    status = F.when(bad, "InvalidNode").when(lost, "NoPath").otherwise("Success")
    why = F.when(F.col("has_from").isNull(), "from node is not in the network").when(bad, "to node is not in the network").when(lost, "no path between the nodes")
    counted = F.col("two") & ~bad & ~lost & (F.col("from_node") != F.col("to_node"))
    side = lambda c: F.when(counted, F.col(c).cast("int")).alias
    seen = F.when(bad | (F.col("from_node") == F.col("to_node")) | (F.col("two") & lost), 0).when(F.col("two"), F.col("released_f") + F.col("released_b")).otherwise(F.coalesce("rank", "all"))
    return out.select(
        "request_id", status.alias("status"), why.alias("failure_reason"), F.col("nodes").alias("path_nodes"), F.col("edges").alias("path_edges"), F.col("cost").alias("total_cost"),
        F.col("distance_nm").alias("total_distance_nm"), seen.cast("int").alias("visited"), side("released_f")("fwd_visited"), side("released_b")("rev_visited"),
    )


def path_length(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """path_id, distance_nm: sum of the great-circle distances between consecutive nodes of path_nodes."""
    at = paths.select("path_id", F.posexplode("path_nodes").alias("pos", "node_id")).join(nodes.select("node_id", "lat", "lon"), "node_id")
    w = Window.partitionBy("path_id").orderBy("pos")
    legs = at.withColumns({"plat": F.lag("lat").over(w), "plon": F.lag("lon").over(w)})
    leg = F.coalesce(haversine_nm(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon")), F.lit(0.0))
    return legs.groupBy("path_id").agg(F.sum(leg).alias("distance_nm"))


def landmark_table(nodes: DataFrame, edges: DataFrame, limit: int = MAX_BROADCAST_EDGES) -> DataFrame:
    """landmark, node_id, from_landmark, to_landmark (null where there is no path)."""
    marks = landmarks(nodes).select(F.col("node_id").alias("source"))
    groups = None if fits(edges, limit) else groups_of(edges)
    out = distances(marks, nodes, edges, False, limit, groups).select(F.col("source").alias("landmark"), "node_id", F.col("distance").alias("from_landmark"))
    into = distances(marks, nodes, edges, True, limit, groups).select(F.col("source").alias("landmark"), "node_id", F.col("distance").alias("to_landmark"))
    return out.join(into, ["landmark", "node_id"], "full_outer")


def landmark_bounds(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """s, t, bound: the largest difference of landmark distances, at least 0."""
    at = table.select("landmark", "node_id", "from_landmark", "to_landmark")
    s = at.toDF("landmark", "s", "s_from", "s_to")
    t = at.toDF("landmark", "t", "t_from", "t_to")
    both = pairs.join(s, "s").join(t, ["landmark", "t"])
    found = both.groupBy("s", "t").agg(F.max(F.greatest(F.col("t_from") - F.col("s_from"), F.col("s_to") - F.col("t_to"))).alias("b"))
    return pairs.join(found, ["s", "t"], "left").select("s", "t", F.greatest(F.coalesce("b", F.lit(0.0)), F.lit(0.0)).alias("bound"))
