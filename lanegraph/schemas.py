"""Schemas of the tables; nothing is inferred."""

from __future__ import annotations

NODES = "node_id int, h3_int long, lat float, lon float, component_id int, node_class short"
EDGES = "edge_id int, src int, dst int, cost float, min_depth_m float, flags int"
PORTALS = "edge_id int, is_explicit boolean, ax double, ay double, bx double, by double"
MASK_META = (
    "width int, height int, pixel_size_m double, min_x double, min_y double, max_x double, max_y double, "
    "dilation_pixels int, tile_w int, tile_h int, tile_cols int, tile_rows int, codec int"
)
MASK_TILES = "tile_index int, land_pixel_count int, payload binary"
HINTS = (
    "corridor_id int, locode string, kind short, flags short, confidence float, support_count int, "
    "coords array<struct<lon:double,lat:double>>, spans array<struct<src:int,dst:int>>, "
    "min_lon double, min_lat double, max_lon double, max_lat double"
)
_PATH = "array<array<double>>"
PORT_FIELDS = {
    "locode": "string",
    "name": "string",
    "port_lat": "double",
    "port_lon": "double",
    "snapped_h3": "string",
    "snapped_lat": "double",
    "snapped_lon": "double",
    "snap_distance_nm": "double",
    "marine_access_h3": "string",
    "marine_access_lat": "double",
    "marine_access_lon": "double",
    "marine_access_source": "string",
    "marine_access_path_coordinates": _PATH,
    "marine_access_path_is_approximate": "boolean",
    "marine_access_path_land_overlap_nm": "double",
    "marine_access_path_is_land_safe": "boolean",
    "marine_access_display_h3": "string",
    "marine_access_display_lat": "double",
    "marine_access_display_lon": "double",
    "marine_access_display_source": "string",
    "marine_access_display_resolution": "int",
    "marine_access_display_path_coordinates": _PATH,
    "marine_access_display_path_starts_at_raw_port": "boolean",
    "marine_access_display_path_land_overlap_nm": "double",
    "marine_access_display_path_is_land_safe": "boolean",
    "component_id": "int",
}
PORTS = ", ".join(f"{k} {v}" for k, v in PORT_FIELDS.items())
