"""Ports: cleaning, routing cells, lookup and checks against the network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanegraph.functions.geo import h3_hex_to_long
from lanegraph.operators.network import h3_lookup


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def valid_ports(records: DataFrame) -> DataFrame:
    """Records with a code, a snapped cell and snapped coordinates; missing names and distances get defaults."""
    keep = ~_blank(F.col("locode")) & ~_blank(F.col("snapped_h3")) & F.col("snapped_lat").isNotNull() & F.col("snapped_lon").isNotNull()
    return records.where(keep).withColumns({
        "name": F.coalesce("name", "locode"),
        "snapped_lat": F.col("snapped_lat").cast("float"),
        "snapped_lon": F.col("snapped_lon").cast("float"),
        "snap_distance_nm": F.coalesce("snap_distance_nm", F.lit(0.0)),
    })


def routing_cell() -> Column:
    """The marine access cell unless it is blank, else the snapped one."""
    return F.when(_blank(F.col("marine_access_h3")), F.col("snapped_h3")).otherwise(F.col("marine_access_h3"))


def list_ports(ports: DataFrame) -> DataFrame:
    return ports.select(
        "locode", "name", "port_lat", "port_lon", F.col("snapped_lat").cast("double").alias("snapped_lat"), F.col("snapped_lon").cast("double").alias("snapped_lon"),
        "marine_access_lat", "marine_access_lon", "marine_access_display_lat", "marine_access_display_lon", "marine_access_display_path_coordinates",
    )


def port_by_locode(ports: DataFrame, locode: str) -> DataFrame:
    return list_ports(ports.where(F.upper("locode") == locode.upper()))


def _located(ports: DataFrame, nodes: DataFrame, cell: Column) -> DataFrame:
    """Ports with node_id and node_component of a cell; both null if it is not in the network."""
    at = ports.withColumn("h3_int", h3_hex_to_long(cell)).join(h3_lookup(nodes), "h3_int", "left")
    return at.join(nodes.select("node_id", F.col("component_id").alias("node_component")), "node_id", "left")


def snap_ports(locodes: DataFrame, ports: DataFrame, nodes: DataFrame) -> DataFrame:
    """locode (any case) to node_id of the port's routing cell, -1 if port or cell is unknown."""
    at = _located(ports, nodes, routing_cell()).select(F.upper("locode").alias("code"), "node_id")
    return locodes.join(at, F.upper(locodes.locode) == F.col("code"), "left").select(locodes.locode, F.coalesce("node_id", F.lit(-1)).alias("node_id"))


def unique_locodes(ports: DataFrame) -> DataFrame:
    """The ports as they are; fails if two share a code in any case."""
    twice = ports.groupBy(F.upper("locode").alias("code")).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"port code {twice[0]['code']} occurs more than once")
    return ports


def port_warnings(ports: DataFrame, nodes: DataFrame) -> DataFrame:
    """locode, warning: ``missing_cell`` or ``component_mismatch`` of the routing cell."""
    at = _located(ports, nodes, routing_cell())
    kind = F.when(F.col("node_id").isNull(), "missing_cell").when(F.col("component_id") != F.col("node_component"), "component_mismatch")
    return at.select("locode", kind.alias("warning")).where("warning is not null")


def port_report(ports: DataFrame, nodes: DataFrame) -> DataFrame:
    """locode, valid, missing, mismatch by the snapped cell; a port whose component differs counts as valid as well."""
    at = _located(ports, nodes, F.col("snapped_h3"))
    found = F.col("node_id").isNotNull()
    return at.select("locode", found.alias("valid"), (~found).alias("missing"), F.coalesce(found & (F.col("component_id") != F.col("node_component")), F.lit(False)).alias("mismatch"))


def marker_points(ports: DataFrame) -> DataFrame:
    """locode with the port's point (raw, else snapped) and access marker (display, else access; null if none)."""
    lon, lat = F.coalesce("marine_access_display_lon", "marine_access_lon"), F.coalesce("marine_access_display_lat", "marine_access_lat")
    has = lon.isNotNull() & lat.isNotNull()
    return ports.select(
        "locode",
        F.coalesce("port_lon", F.col("snapped_lon").cast("double")).alias("lon"),
        F.coalesce("port_lat", F.col("snapped_lat").cast("double")).alias("lat"),
        F.when(has, lon).alias("access_lon"),
        F.when(has, lat).alias("access_lat"),
    )


def port_features(ports: DataFrame, from_locode: str | None, to_locode: str | None) -> DataFrame:
    """locode, role and the GeoJSON point feature of every port."""
    role = F.lit("none")
    if to_locode is not None:
        role = F.when(F.col("locode") == to_locode, "to").otherwise(role)
    if from_locode is not None:
        role = F.when(F.col("locode") == from_locode, "from").otherwise(role)
    p = marker_points(ports).join(ports.select("locode", "name"), "locode").withColumn("role", role)
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct("locode", "name", "role").alias("properties"))
    return p.select("locode", "role", F.to_json(feature).alias("feature"))


def access_connectors(ports: DataFrame, from_locode: str | None, to_locode: str | None) -> DataFrame:
    """role, locode, segment, points: the display paths of the two chosen ports, cut at the anti-meridian."""
    from lanegraph.operators.geometry import split_segments

    chosen = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("code")) for r, c in (("from", from_locode), ("to", to_locode)) if c is not None]) if (from_locode or to_locode) else F.array().cast("array<struct<role:string,code:string>>")
    picked = ports.where("marine_access_display_path_coordinates is not null").select("locode", F.col("marine_access_display_path_coordinates").alias("points"), F.explode(chosen).alias("c"))
    cut = picked.where(F.col("c.code") == F.col("locode")).select(F.col("c.role").alias("role"), "locode", F.posexplode(split_segments(F.col("points"))).alias("segment", "points"))
    return cut.where(F.size("points") >= 2)
