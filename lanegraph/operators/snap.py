"""Nearest cells within a radius: an exact grid join instead of a tree."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanegraph.functions.geo import EARTH_RADIUS_NM, haversine_nm
from lanegraph.shared import materialize, spread

#: Grids of ``nearest``: steps from the coarsest, which fits the radius, to the finest.
FINER = 16


def _grid(radius_nm: float) -> tuple[float, float, int, float, float]:
    """Degrees that the radius spans, height of the bands, slots round the globe, their width, and the sine of the radius."""
    deg = math.degrees(min(math.pi, radius_nm / EARTH_RADIUS_NM))
    height = min(180.0, max(deg * (1 + 1e-9) + 1e-9, 1e-3))
    slots = max(1, math.floor(360.0 / height))
    return deg, height, slots, 360.0 / slots, math.sin(math.radians(min(deg, 90.0)))


def _near(queries: DataFrame, nodes: DataFrame, radii: list[float], tasks: int | None = None) -> DataFrame:
    """query_id, node_id, component_id, distance_nm for every node within ``reach`` of every query (query_id, q_lat, q_lon, size, reach).

    ``size`` is the place in ``radii`` of the radius that a query's grid is made for, no less than its reach. Nodes lie
    in cells of latitude bands as high as that radius; a band's cells are as wide in degrees as the radius can reach there.
    A query is copied to the cells that its circle touches (three bands; longitudes wrap; a circle round a pole takes
    whole bands), so an equi-join finds all of its nodes. Cells are finer, the smaller the radius, so nodes are not gathered
    per query and no side need be broadcast.
    """
    deg, height, slots, width, sine = (F.get(F.array(*[F.lit(v) for v in values]), F.col("size")) for values in zip(*map(_grid, radii)))
    band_of = lambda lat: F.floor((lat.cast("double") + 90.0) / height).cast("int")
    slot_of = lambda lon: F.least(slots - 1, F.floor(F.pmod(lon.cast("double") + 180.0, F.lit(360.0)) / width)).cast("int")
    placed = nodes.select("node_id", "component_id", F.col("lat").cast("double").alias("n_lat"), F.col("lon").cast("double").alias("n_lon"))
    placed = placed.withColumn("size", F.explode(F.array(*[F.lit(i) for i in range(len(radii))])))
    placed = placed.withColumns({"band": band_of(F.col("n_lat")), "slot": slot_of(F.col("n_lon"))})
    top = F.floor(F.lit(180.0) / height).cast("int")
    q = queries.withColumn("band", F.explode(F.sequence(F.greatest(F.lit(0), band_of(F.col("q_lat") - deg)), F.least(top, band_of(F.col("q_lat") + deg)))))
    # asin(sin r / cos lat) bounds the longitude difference anywhere on a circle that holds no pole.
    polar = F.abs("q_lat") + deg >= 90.0
    span = F.degrees(F.asin(F.least(F.lit(1.0), sine / F.cos(F.radians("q_lat"))))) + 1e-6
    q = q.withColumns({"polar": polar, "span": span}).withColumn("steps", F.ceil(F.col("span") * 2 / width).cast("int"))
    touched = F.transform(F.sequence(F.lit(0), F.col("steps")), lambda i: slot_of(F.col("q_lon") + F.least(F.col("span"), i * width - F.col("span"))))
    every = F.sequence(F.lit(0), slots - 1)
    q = q.withColumn("slot", F.explode(F.array_distinct(F.when(F.col("polar") | (F.col("steps") >= slots), every).otherwise(touched))))
    q = q.select("query_id", "q_lat", "q_lon", "reach", "size", "band", "slot")
    if tasks:
        q = q.repartition(tasks, "size", "band", "slot")
    near = q.join(placed, ["size", "band", "slot"]).withColumn("distance_nm", haversine_nm(F.col("q_lat"), F.col("q_lon"), F.col("n_lat"), F.col("n_lon")))
    return near.where(F.col("distance_nm") <= F.col("reach")).select("query_id", "node_id", "component_id", "distance_nm")


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.col("lat").cast("double").alias("q_lat"), F.col("lon").cast("double").alias("q_lon"))


def within_radius(queries: DataFrame, nodes: DataFrame, radius_nm: float) -> DataFrame:
    """query_id, node_id, component_id, distance_nm for every node within the radius of every query (query_id, lat, lon)."""
    return _near(_asked(queries).withColumns({"size": F.lit(0), "reach": F.lit(float(radius_nm))}), nodes, [radius_nm])


def _reaches(queries: DataFrame, nodes: DataFrame, k: int, radius_nm: float) -> DataFrame:
    """Queries with ``reach``: a distance, no more than the radius, within which a query's k nearest nodes of the radius lie.

    Any k nodes bound the distance of the k nearest. They are taken from the query's own cell of square grids, each twice as
    fine as the one before, as far as any cell holds k nodes. A query in no such cell keeps the whole radius.
    """
    first = max(0, math.floor(math.log2(180.0 / max(_grid(radius_nm)[0], 1e-3))))
    last = first + FINER
    cell = lambda lat, lon: F.struct(
        F.floor((F.col(lat) + 90.0) / 180.0 * F.pow(F.lit(2.0), "level")).cast("long").alias("row"), F.floor(F.pmod(F.col(lon) + 180.0, F.lit(360.0)) / 180.0 * F.pow(F.lit(2.0), "level")).cast("long").alias("col")
    )
    placed = nodes.select("node_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).withColumn("level", F.explode(F.sequence(F.lit(first), F.lit(last))))
    nth = F.row_number().over(Window.partitionBy("level", "cell").orderBy("node_id"))
    some = placed.withColumn("cell", cell("lat", "lon")).withColumn("nth", nth).where(F.col("nth") <= k)
    full = materialize(some.groupBy("level", "cell").agg(F.collect_list(F.struct("lat", "lon")).alias("some")).where(F.size("some") == k), "cells")
    last = full.agg(F.max("level")).first()[0] or first
    asked = _asked(queries).repartition(spread(queries.sparkSession))  # the file they come from may be small for what each is copied to
    asked = asked.withColumn("level", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("cell", cell("q_lat", "q_lon"))
    far = F.array_max(F.transform("some", lambda n: haversine_nm(F.col("q_lat"), F.col("q_lon"), n["lat"], n["lon"])))
    met = asked.join(full, ["level", "cell"], "left").withColumn("far", F.least(far * (1 + 1e-9) + 1e-9, F.lit(float(radius_nm))))
    found = met.groupBy("query_id", "q_lat", "q_lon").agg(F.coalesce(F.min("far"), F.lit(float(radius_nm))).alias("reach"), F.count_if(F.col("level") == first).alias("times"))
    return found.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("time", "times")


def nearest(queries: DataFrame, nodes: DataFrame, k: int = 5, radius_nm: float = 100.0, component: int | None = None) -> DataFrame:
    """The k nearest nodes of each query within the radius, rank from 1, ties by node id; ``component`` filters before the limit.

    Each query is joined within a reach of its own, so that it meets about as many nodes as it asks for, however many lie within the radius.
    """
    nodes = (nodes if component is None else nodes.where(F.col("component_id") == component)).where("lat is not null and lon is not null")
    size = F.greatest(F.lit(0), F.least(F.lit(FINER), F.floor(F.log2(F.lit(float(radius_nm)) / F.greatest(F.col("reach"), F.lit(1e-9))) * 2 - 1e-6))).cast("int")
    asked = materialize(_reaches(queries, nodes, k, radius_nm).withColumn("size", size), "reaches")
    found = _near(asked, nodes, [radius_nm / 2 ** (i / 2) for i in range(FINER + 1)], spread(queries.sparkSession))
    w = Window.partitionBy("query_id").orderBy("distance_nm", "node_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def snap_coordinates(queries: DataFrame, nodes: DataFrame, radius_nm: float = 100.0, k: int = 5) -> DataFrame:
    """query_id, node_id: the nearest of the k nodes that has a component, else the nearest, else -1."""
    near = nearest(queries, nodes, k, radius_nm)
    best = near.groupBy("query_id").agg(F.min_by("node_id", F.struct(F.col("component_id") < 0, "distance_nm", "node_id")).alias("node_id"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("node_id", F.lit(-1)).alias("node_id"))
