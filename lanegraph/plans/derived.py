"""A routing network made from relational tables, so that every operator can be tried on tables of any size.

Suppliers are cells, consecutive suppliers of an order are edges, customers ask for snaps and routes, nations
are ports, events are tracks, orders are paths, and the first two legs of every order are a corridor hint. All
rows of the tables are used. The same formulas are given as DuckDB SQL in ``CTES``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanegraph.operators.network import row_offsets, with_ends
from lanegraph.shared import free_shuffles, materialize, materialize_bucketed, remove_table, spread

H3_BASE, H3_STEP = 600000000000000000, 1000003
SNAP_RADIUS_NM = 1500.0
MASK = {"width": 401, "height": 241, "pixel_size_m": 100000.0, "min_x": -20050000.0, "min_y": -12050000.0, "max_x": 20050000.0, "max_y": 12050000.0}


def _lat(i: str, scale: int) -> str:
    return f"CAST(({i} * {scale}) % 1201 AS DOUBLE) / 10 - 60"


def _lon(i: str, scale: int, span: int = 3400, shift: int = 170) -> str:
    return f"CAST(({i} * {scale}) % {span} AS DOUBLE) / 10 - {shift}"


NODE_LAT, NODE_LON = _lat("s_suppkey", 37), _lon("s_suppkey", 73)
NODES = f"SELECT CAST(s_suppkey AS INT) AS node_id, {H3_BASE} + s_suppkey * {H3_STEP} AS h3_int, {NODE_LAT} AS lat, {NODE_LON} AS lon, CAST(s_nationkey % 5 - 1 AS INT) AS component_id, CAST(s_nationkey % 4 AS SMALLINT) AS node_class FROM supplier"
QUERIES = f"SELECT c_custkey AS query_id, {_lat('c_custkey', 53)} AS lat, {_lon('c_custkey', 91)} AS lon FROM customer"
TRACKS = f"SELECT user_id AS track_id, event_id, ts, {_lat('event_id', 53)} AS lat, {_lon('event_id', 91, 3600, 180)} AS lon FROM events"
ITEM_ORDER = "l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice"
LEGS = f"SELECT l_orderkey AS path_id, CAST(row_number() OVER w - 1 AS INT) AS pos, CAST(l_suppkey AS INT) AS node_id, CAST(lead(l_suppkey) OVER w AS INT) AS next_id, l_quantity FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {ITEM_ORDER})"
EDGE_TEST = "node_id <> next_id"
_PORT_LAT, _PORT_LON = _lat("n_nationkey * 5", 37), _lon("n_nationkey * 5", 73)
PORTS = f"""SELECT concat('N', lpad(CAST(n_nationkey AS STRING), 4, '0')) AS locode, CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE n_name END AS name,
 CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE {_PORT_LAT} + 0.5 END AS port_lat, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE {_PORT_LON} + 0.25 END AS port_lon,
 CASE WHEN n_nationkey % 11 = 10 THEN ' ' ELSE lower(hex({H3_BASE} + n_nationkey * 5 * {H3_STEP})) END AS snapped_h3, CASE WHEN n_nationkey = 13 THEN NULL ELSE {_PORT_LAT} END AS snapped_lat, {_PORT_LON} AS snapped_lon,
 CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE CAST(n_nationkey AS DOUBLE) / 4 END AS snap_distance_nm,
 CASE WHEN n_nationkey % 3 = 0 THEN lower(hex({H3_BASE} + (n_nationkey * 5 + 1) * {H3_STEP})) WHEN n_nationkey % 3 = 1 THEN '' ELSE NULL END AS marine_access_h3,
 CASE WHEN n_nationkey % 3 = 0 THEN {_PORT_LAT} + 1.0 ELSE NULL END AS marine_access_lat, CASE WHEN n_nationkey % 3 = 0 THEN {_PORT_LON} + 1.0 ELSE NULL END AS marine_access_lon,
 CASE WHEN n_nationkey % 5 = 0 THEN {_PORT_LAT} + 2.0 ELSE NULL END AS marine_access_display_lat, CASE WHEN n_nationkey % 5 = 0 THEN {_PORT_LON} + 2.0 ELSE NULL END AS marine_access_display_lon,
 CASE WHEN n_nationkey % 8 = 7 THEN NULL ELSE CAST(n_nationkey % 5 - 1 AS INT) END AS component_id FROM nation"""
#: Hints: the first two legs of every order's path with three nodes or more.
HINT_ROWS = """SELECT path_id AS corridor_id, concat('n', lpad(CAST(path_id % 25 AS STRING), 4, '0')) AS locode, CAST(1 + path_id % 2 AS SMALLINT) AS kind,
 CAST(path_id % 3 AS SMALLINT) AS flags, CAST((path_id * 7) % 100 AS DOUBLE) / 100 AS confidence"""
LAND_TEST = "(row * 7 + col * 13) % 97 = 0"


class Derived:
    """Tables of the derived network as DataFrames. The edges, which most queries read several times, are written once; the others are plans."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        free_shuffles(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, **tables: DataFrame) -> DataFrame:
        """``text`` over the named tables; other tables are read on mention."""
        named = {}
        for name in ("supplier", "customer", "nation", "lineitem", "events", "orders"):
            if f"FROM {name}" in text:
                named[name] = self.table(name)
        named |= tables
        marked = text
        for name in named:
            marked = marked.replace(f"FROM {name}", "FROM {" + name + "}")
        return self.spark.sql(marked, **named)

    @cached_property
    def nodes(self) -> DataFrame:
        return self.sql(NODES)

    @cached_property
    def queries(self) -> DataFrame:
        return self.sql(QUERIES)

    @cached_property
    def tracks(self) -> DataFrame:
        return self.sql(TRACKS)

    @cached_property
    def legs(self) -> DataFrame:
        """LEGS without the last column of its order, which need not be shuffled: rows that differ in nothing else have the same cell and quantity."""
        order = ITEM_ORDER.split(", ")[:-1]
        items = self.table("lineitem").select(F.col("l_orderkey").alias("path_id"), *order)
        along = Window.partitionBy("path_id").orderBy(*order)
        pos, ahead = (F.row_number().over(along) - 1).cast("int"), F.lead("l_suppkey").over(along).cast("int")
        return items.select("path_id", pos.alias("pos"), F.col("l_suppkey").cast("int").alias("node_id"), ahead.alias("next_id"), "l_quantity")

    @cached_property
    def steps(self) -> DataFrame:
        """path_id, pos, src, dst of consecutive path nodes."""
        return self.legs.where("next_id is not null").select("path_id", "pos", F.col("node_id").alias("src"), F.col("next_id").alias("dst"))

    @cached_property
    def paths(self) -> DataFrame:
        node = F.struct("pos", "node_id")
        return self.legs.groupBy("path_id").agg(F.transform(F.sort_array(F.collect_list(node)), lambda s: s["node_id"]).alias("path_nodes"))

    @cached_property
    def edges(self) -> DataFrame:
        legs = self.legs.where(f"next_id is not null and {EDGE_TEST}").select(F.col("node_id").alias("src"), F.col("next_id").alias("dst"), F.col("l_quantity").cast("float").alias("cost"))
        legs = materialize(legs, "legs")  # by itself, so that no two shuffles of the items lie on disk together
        kept = legs.repartition(spread(self.spark), "src").groupBy("src", "dst").agg(F.min("cost").alias("cost"))
        nth = F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1
        pairs = materialize_bucketed(kept.withColumn("nth", nth), "pairs", "src")
        remove_table(legs)
        starts = row_offsets(pairs.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))).select(F.col("node_id").alias("src"), "row_start")
        made = pairs.join(starts, "src").select((F.col("row_start") + F.col("nth")).cast("int").alias("edge_id"), "src", "dst", "cost")
        edges = materialize_bucketed(made, "edges", "src")  # joins on src read it in place
        remove_table(pairs)
        return edges

    @cached_property
    def ports(self) -> DataFrame:
        path = F.when(F.col("port_lon").isNotNull() & (F.length("marine_access_h3") > 2), F.array(F.array("port_lon", "port_lat"), F.array("marine_access_lon", "marine_access_lat")))
        return self.sql(PORTS).withColumn("marine_access_path_coordinates", path).withColumn("marine_access_display_path_coordinates", path)

    @cached_property
    def portals(self) -> DataFrame:
        return self.portals_of(self.edges)

    def portals_of(self, edges: DataFrame) -> DataFrame:
        """The portals of some of the edges."""
        ends = with_ends(edges, self.nodes).where("edge_id % 5 <> 0")
        mid = lambda a, b: (F.col(a) + F.col(b)) / 2
        x, y = mid("src_lon", "dst_lon"), mid("src_lat", "dst_lat")
        return ends.select("edge_id", (F.col("edge_id") % 2 == 0).alias("is_explicit"), (x + 0.5).alias("ax"), (y - 0.5).alias("ay"), (x - 0.5).alias("bx"), (y + 0.5).alias("by"))

    @cached_property
    def hints(self) -> DataFrame:
        spans = self.steps.where("pos < 2")
        step = F.struct("pos", "src", "dst")
        rows = spans.groupBy("path_id").agg(F.sort_array(F.collect_list(step)).alias("s")).where("size(s) = 2")
        rows = rows.select("path_id", F.transform("s", lambda x: F.struct(x["src"].alias("src"), x["dst"].alias("dst"))).alias("spans"))
        point = lambda v: F.struct((F.pmod(v * 73, F.lit(3400)).cast("double") / 10 - 170).alias("lon"), (F.pmod(v * 37, F.lit(1201)).cast("double") / 10 - 60).alias("lat"))
        coords = F.array(point(F.get("spans", F.lit(0))["src"]), point(F.get("spans", F.lit(0))["dst"]), point(F.get("spans", F.lit(1))["dst"]))
        head = self.sql(HINT_ROWS + ", spans FROM rows", rows=rows)
        return head.withColumn("coords", coords)

    @cached_property
    def mask_cells(self) -> DataFrame:
        """All land cells of the derived mask."""
        rows = self.spark.range(MASK["height"]).select(F.col("id").cast("int").alias("row"))
        cells = rows.select("row", F.explode(F.sequence(F.lit(0), F.lit(MASK["width"] - 1))).alias("col"))
        return cells.where(LAND_TEST)


def duck(text: str) -> str:
    """The same formula in DuckDB: STRING is VARCHAR there, hex of a number is to_hex."""
    return text.replace("AS STRING", "AS VARCHAR").replace("lower(hex(", "lower(to_hex(")


CTES = {
    "nodes": duck(NODES),
    "queries": duck(QUERIES),
    "tracks": duck(TRACKS),
    "legs": duck(LEGS),
    "steps": "SELECT path_id, pos, node_id AS src, next_id AS dst FROM legs WHERE next_id IS NOT NULL",
    "edges": f"SELECT CAST(row_number() OVER (ORDER BY node_id, next_id) - 1 AS INT) AS edge_id, node_id AS src, next_id AS dst, CAST(min(l_quantity) AS FLOAT) AS cost FROM legs WHERE next_id IS NOT NULL AND {EDGE_TEST} GROUP BY node_id, next_id",
    "ports": duck(PORTS),
    "ends": "SELECT e.*, a.lat AS src_lat, a.lon AS src_lon, b.lat AS dst_lat, b.lon AS dst_lon FROM edges e JOIN nodes a ON a.node_id = e.src JOIN nodes b ON b.node_id = e.dst",
    "portals": 'SELECT edge_id, edge_id % 2 = 0 AS is_explicit, (src_lon + dst_lon) / 2 + 0.5 AS ax, (src_lat + dst_lat) / 2 - 0.5 AS ay, (src_lon + dst_lon) / 2 - 0.5 AS bx, (src_lat + dst_lat) / 2 + 0.5 AS "by" FROM ends WHERE edge_id % 5 <> 0',
    "hint_spans": "SELECT path_id, pos, src, dst FROM steps WHERE pos < 2 AND path_id IN (SELECT path_id FROM steps WHERE pos = 1)",
    "hints": duck(HINT_ROWS) + " FROM (SELECT DISTINCT path_id FROM hint_spans)",
    "mask_cells": f"SELECT CAST(r.range AS INT) AS row, CAST(c.range AS INT) AS col FROM range({MASK['height']}) r, range({MASK['width']}) c WHERE (r.range * 7 + c.range * 13) % 97 = 0",
    "hit": """SELECT query_id, node_id, component_id, distance_nm FROM (SELECT q.query_id, n.node_id, n.component_id, HAVERSINE(q.lat, q.lon, n.lat, n.lon) AS distance_nm FROM queries q, nodes n) WHERE distance_nm <= 1500.0""",
}
NEEDS = {
    "steps": ["legs"], "edges": ["legs"], "ends": ["edges", "nodes"], "portals": ["ends"], "hint_spans": ["steps"], "hints": ["hint_spans"], "hit": ["queries", "nodes"],
}


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"sin(radians({lat2} - {lat1}) / 2) * sin(radians({lat2} - {lat1}) / 2) + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lon2} - {lon1}) / 2) * sin(radians({lon2} - {lon1}) / 2)"
    return f"(6880.13 * asin(sqrt(least(1.0, {a}))))"


def with_ctes(names: str, body: str, recursive: bool = False) -> str:
    """``body`` preceded by the named derived tables and what they need. HAVERSINE(a, b, c, d) is expanded."""
    import re

    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    text = ", ".join(f"{n} AS ({CTES[n]})" for n in order)
    sep = ", " if body.lstrip().startswith("+") else " "
    full = f"WITH {'RECURSIVE ' if recursive else ''}{text}{sep}{body.lstrip().lstrip('+')}"
    return re.sub(r"HAVERSINE\(([^,()]+), ([^,()]+), ([^,()]+), ([^,()]+)\)", lambda m: haversine_sql(*m.groups()), full)
