"""Views of the network: offsets, decoded targets, reverse adjacency, components, landmarks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanegraph.functions.geo import haversine_nm
from lanegraph.shared import materialize, materialize_bucketed, remove_table, spread

DELTA_OVERFLOW = -32768
#: Edges of a node that lie in one row of ``adjacency``.
PIECE = 4096
#: Links that a task of ``linked_groups`` reduces to a forest at a time.
FOREST_LINKS = 1 << 20


def row_offsets(degrees: DataFrame, blocks: int | None = None) -> DataFrame:
    """node_id, degree to node_id, row_start, row_end: the running sum of degrees by node.

    Dense ids are cut into blocks (four per shuffle partition unless said otherwise); blocks are summed first and
    prefixed, so the running sums inside them are parallel.
    """
    blocks = blocks or 4 * int(degrees.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.greatest(F.lit(1), F.ceil((F.lit(_bound(degrees, "node_id")) + 1) / blocks)).cast("long")
    cut = degrees.withColumn("block", F.floor(F.col("node_id") / size).cast("int"))
    sums = cut.groupBy("block").agg(F.sum("degree").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("block", before.alias("before"))  # one row per block
    within = F.sum("degree").over(Window.partitionBy("block").orderBy("node_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return cut.withColumn("within", within).join(starts, "block").select("node_id", (F.col("before") + F.col("within") - F.col("degree")).alias("row_start"), (F.col("before") + F.col("within")).alias("row_end"))


def places(rows: DataFrame, order: list[tuple[Column, bool]], name: str) -> DataFrame:
    """Rows with their place (from 1) in a total order of (column, falling): sorted by ranges, counted within each, and the ranges' counts summed up."""
    keys = {f"__o{i}": c for i, (c, _) in enumerate(order)}
    by = [F.col(k).desc() if falling else F.col(k) for k, (_, falling) in zip(keys, order)]
    dealt = rows.withColumns(keys).repartitionByRange(spread(rows.sparkSession), *by)
    cut = materialize(dealt.withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy("__range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per range
    nth = F.row_number().over(Window.partitionBy("__range").orderBy(*by))
    found = cut.withColumn("__nth", nth).join(F.broadcast(sizes.select("__range", before.alias("__before"))), "__range")
    return found.select(*rows.columns, (F.col("__before") + F.col("__nth")).cast("int").alias(name))


def _bound(df: DataFrame, column: str) -> int:
    return int(df.agg(F.max(column)).first()[0] or 0)


def out_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    counted = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))
    return nodes.select("node_id").join(counted, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("in_degree"))


def adjacency(edges: DataFrame, reverse: bool = False) -> DataFrame:
    """at, steps array<struct<cost, edge, node>>: the edges from each node (or into it), in buckets by node and cut into rows of about PIECE."""
    at, to = ("dst", "src") if reverse else ("src", "dst")
    step = F.struct(F.col("cost").cast("double").alias("cost"), F.col("edge_id").cast("int").alias("edge"), F.col(to).cast("int").alias("node"))
    rows = edges.select(F.col(at).cast("int").alias("at"), step.alias("step")).repartition(spread(edges.sparkSession), "at")
    nth = F.row_number().over(Window.partitionBy("at").orderBy("step.edge"))
    cut = rows.withColumn("piece", F.floor(nth / PIECE))  # all in the task that has the node
    return materialize_bucketed(cut.groupBy("at", "piece").agg(F.collect_list("step").alias("steps")).select("at", "steps"), "adjacency", "at")


def _forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Links (a, b) from every node but the smallest of a group of linked nodes to that smallest one; as many as nodes at most."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    least = np.arange(len(nodes))
    while True:
        left, right = least[x], least[y]
        differ = left != right
        if not differ.any():
            break
        x, y, left, right = x[differ], y[differ], left[differ], right[differ]
        np.minimum.at(least, np.maximum(left, right), np.minimum(left, right))
        while (least[least] != least).any():
            least = least[least]
    moved = np.flatnonzero(least != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved].astype(np.int32)), pa.array(nodes[least[moved]].astype(np.int32))], names=["a", "b"])


def _forests(batches):
    """Links of a partition as forests of FOREST_LINKS links each."""
    held, n = [], 0
    for batch in batches:
        held.append([batch.column(i).to_numpy() for i in range(2)])
        n += batch.num_rows
        if n >= FOREST_LINKS:
            yield _forest(*map(np.concatenate, zip(*held)))
            held, n = [], 0
    if n:
        yield _forest(*map(np.concatenate, zip(*held)))


def linked_groups(edges: DataFrame) -> DataFrame:
    """node, group: the smallest node among all that edges link to it, whatever their direction. Only nodes with edges to others.

    By stars: every node hands its larger neighbours to the smallest node it knows, then every node its smaller ones,
    until nothing changes; links only ever get fewer, and no task holds a group. Tasks first reduce the edges as they lie
    to forests, so that of a dense network few links are shuffled.
    """
    links = edges.where("src <> dst").select(F.greatest("src", "dst").cast("int").alias("a"), F.least("src", "dst").cast("int").alias("b"))
    links = materialize(links.mapInArrow(_forests, "a int, b int").distinct(), "links")
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = materialize(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links")
        remove_table(links)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        links = materialize(small.distinct(), "links")
        remove_table(large)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
    groups = links.select(F.col("a").alias("node"), F.col("b").alias("group"))
    return groups.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("group")).distinct())


def encode_targets(edges: DataFrame, limit: int = 32767) -> DataFrame:
    """edge_id, src, delta, overflow_target: the delta form of an edge's target; a delta out of range is DELTA_OVERFLOW."""
    d = F.col("dst") - F.col("src")
    far = F.abs(d) > limit
    return edges.select("edge_id", "src", F.when(far, DELTA_OVERFLOW).otherwise(d).cast("int").alias("delta"), F.when(far, F.col("dst")).alias("overflow_target"))


def decode_targets(coded: DataFrame, overflow: DataFrame) -> DataFrame:
    """``overflow``: position, target. Every sentinel must have an entry at its edge and every entry a sentinel, else the query fails."""
    joined = coded.join(overflow, coded.edge_id == overflow.position, "full_outer")
    marked = F.col("delta") == DELTA_OVERFLOW
    fault = F.col("edge_id").isNull() | (marked & F.col("position").isNull()) | (~marked & F.col("position").isNotNull())
    target = F.when(fault, F.raise_error(F.lit("overflow targets do not match their edges")).cast("int")).when(marked, F.col("target")).otherwise(F.col("src") + F.col("delta"))
    return joined.select("edge_id", "src", target.cast("int").alias("dst"))


def reverse_adjacency(edges: DataFrame) -> DataFrame:
    """dst, slot (from 0 in edge order), src, edge_id: the incoming edges of each node."""
    w = Window.partitionBy("dst").orderBy("edge_id")
    return edges.select("dst", (F.row_number().over(w) - 1).alias("slot"), "src", "edge_id")


def component_stats(nodes: DataFrame) -> DataFrame:
    """component_id, node_count, dominant: sizes without negative ids; among the largest the one seen first dominates."""
    sizes = nodes.where("component_id >= 0").groupBy("component_id").agg(F.count("*").alias("node_count"), F.min("node_id").alias("seen"))
    best = sizes.agg(F.max_by("component_id", F.struct("node_count", -F.col("seen"))).alias("best"))
    return sizes.crossJoin(F.broadcast(best)).select("component_id", "node_count", (F.col("component_id") == F.col("best")).alias("dominant"))


def landmark_component(nodes: DataFrame) -> DataFrame:
    """The component that landmarks come from: of the largest, the one whose last node comes first."""
    sizes = nodes.where("component_id >= 0").groupBy("component_id").agg(F.count("*").alias("node_count"), F.max("node_id").alias("full"))
    return sizes.agg(F.max_by("component_id", F.struct("node_count", -F.col("full"))).alias("component_id")).where("component_id is not null")


def landmarks(nodes: DataFrame) -> DataFrame:
    """place, node_id: west-, east-, south- and northernmost node of that component, lowest id on ties, without repeats."""
    inside = nodes.join(F.broadcast(landmark_component(nodes)), "component_id")
    low = lambda c: F.min_by("node_id", F.struct(c, "node_id"))
    high = lambda c: F.max_by("node_id", F.struct(c, -F.col("node_id")))
    chosen = inside.agg(F.array_distinct(F.array(low("lon"), high("lon"), low("lat"), high("lat"))).alias("ids"))
    return chosen.select(F.posexplode("ids").alias("place", "node_id")).where("node_id is not null")


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the coordinates of both ends."""
    a = nodes.select(F.col("node_id").alias("src"), F.col("lat").cast("double").alias("src_lat"), F.col("lon").cast("double").alias("src_lon"))
    b = nodes.select(F.col("node_id").alias("dst"), F.col("lat").cast("double").alias("dst_lat"), F.col("lon").cast("double").alias("dst_lon"))
    return edges.join(a, "src").join(b, "dst")


def edge_nm() -> Column:
    return haversine_nm(F.col("src_lat"), F.col("src_lon"), F.col("dst_lat"), F.col("dst_lon"))


def min_cost_rate(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Smallest cost per nautical mile over edges of positive cost and length; 0 if there is none."""
    rate = F.when((F.col("nm") > 1e-9) & (F.col("cost") > 0), F.col("cost").cast("double") / F.col("nm"))
    return with_ends(edges, nodes).withColumn("nm", edge_nm()).agg(F.coalesce(F.min(rate), F.lit(0.0)).alias("min_cost_per_nm"))


def graph_stats(nodes: DataFrame, edges: DataFrame, ports: DataFrame, resolution: int = 5) -> DataFrame:
    n = nodes.agg(F.count("*").alias("node_count"), F.count_distinct(F.when(F.col("component_id") >= 0, F.col("component_id"))).alias("component_count"))
    e = edges.agg(F.count("*").alias("edge_count"))
    p = ports.agg(F.count("*").alias("port_count"))
    one = n.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(p))  # one row each
    return one.select("node_count", "edge_count", F.lit(resolution).alias("resolution"), "component_count", "port_count")


def component_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pair columns (a, b) with same_component (equal ids, even negative ones) and routable (both ids at least 0 as well)."""
    comp = nodes.select("node_id", "component_id")
    j = pairs.join(comp.toDF("a", "ca"), "a", "left").join(comp.toDF("b", "cb"), "b", "left")
    same = F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))
    return j.select("a", "b", same.alias("same_component"), F.coalesce(same & (F.col("ca") >= 0), F.lit(False)).alias("routable"))


def h3_lookup(nodes: DataFrame) -> DataFrame:
    """h3_int to node_id; of several nodes of a cell the last one counts."""
    return nodes.groupBy("h3_int").agg(F.max("node_id").alias("node_id"))


def with_cell(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows whose h3_int is a cell of the network."""
    return asked.join(nodes.select("h3_int"), "h3_int", "left_semi")


def component_of(rows: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Rows with the component_id of their ``node``; a node that is not in the network drops out."""
    return rows.join(nodes.select(F.col("node_id").alias(node), "component_id"), node)


def edge_portals(edges: DataFrame, portals: DataFrame) -> DataFrame:
    """edge_id with its portal; nulls where it has none."""
    return edges.select("edge_id").join(portals, "edge_id", "left")


def in_offsets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, row_start, row_end: where each node's incoming edges lie if edges are ordered by target."""
    counted = nodes.select("node_id").join(in_degrees(edges), "node_id", "left")
    return row_offsets(counted.select("node_id", F.coalesce("in_degree", F.lit(0)).alias("degree")))


def first_edges(edges: DataFrame) -> DataFrame:
    """(src, dst) to the first of its parallel edges."""
    return edges.groupBy("src", "dst").agg(F.min("edge_id").alias("edge_id"))


def source_by_range(edge_ids: DataFrame, offsets: DataFrame) -> DataFrame:
    """edge_id to its source by the offsets alone: each node is spread over its own edge positions, then an equi-join."""
    spread = offsets.where("row_end > row_start").select("node_id", F.explode(F.sequence(F.col("row_start"), F.col("row_end") - 1)).alias("edge_id"))
    return edge_ids.join(spread, "edge_id").select("edge_id", F.col("node_id").alias("src"))


def bit_counts(packed: DataFrame) -> DataFrame:
    """byte_index, byte to the number of set bits of all bytes."""
    return packed.agg(F.sum(F.bit_count(F.col("byte").cast("long"))).alias("set_bits"))


def explicit_rank(flags: DataFrame) -> DataFrame:
    """edge_id, is_explicit (0/1) to rank among explicit edges (from 0), in blocks of edge ids like ``row_offsets``."""
    offsets = row_offsets(flags.select(F.col("edge_id").alias("node_id"), F.col("is_explicit").alias("degree")))
    return offsets.where("row_end > row_start").select(F.col("node_id").alias("edge_id"), F.col("row_start").alias("explicit_rank"))
