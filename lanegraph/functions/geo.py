"""Scalar geometry and parsing as Column expressions; all of them stay inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
EARTH_RADIUS_NM = 3440.065
EARTH_RADIUS_M = 6378137.0
MAX_MERCATOR_LAT = 85.05112878
POINT_TOLERANCE = 1e-12
ANTIMERIDIAN_DEGREES = 180.0
KM_PER_NM = 1.852
CRUISE_KNOTS = 15.0


def _d(c: Column) -> Column:
    return c.cast("double")


def haversine_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in nautical miles, null if a coordinate is; the argument of asin is cut at 1."""
    lat1, lon1, lat2, lon2 = map(_d, (lat1, lon1, lat2, lon2))
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return F.lit(2 * EARTH_RADIUS_NM) * F.asin(F.sqrt(F.when(a > 1.0, F.lit(1.0)).otherwise(a)))


def haversine_py(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """The same for workers."""
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_NM * math.asin(math.sqrt(min(1.0, a)))


def normalize_lon_delta(d: Column) -> Column:
    """A longitude difference brought into (-180, 180]."""
    return _d(d) - F.lit(360.0) * F.ceil((_d(d) - F.lit(180.0)) / F.lit(360.0))


def mercator_x(lon: Column) -> Column:
    return F.lit(EARTH_RADIUS_M) * _d(lon) * F.lit(math.pi) / F.lit(180.0)


def mercator_y(lat: Column) -> Column:
    cut = F.greatest(F.lit(-MAX_MERCATOR_LAT), F.least(F.lit(MAX_MERCATOR_LAT), _d(lat)))
    return F.lit(EARTH_RADIUS_M) * F.log(F.tan(F.lit(math.pi / 4) + cut * F.lit(math.pi) / F.lit(360.0)))


def _cell(offset: Column, pixel: Column, count: Column) -> Column:
    return F.greatest(F.lit(0), F.least(count - 1, (offset / pixel).cast("int")))


def raster_col(x: Column, min_x: Column, pixel: Column, width: Column) -> Column:
    return _cell(x - min_x, pixel, width)


def raster_row(y: Column, max_y: Column, pixel: Column, height: Column) -> Column:
    """Rows count down from the upper edge."""
    return _cell(max_y - y, pixel, height)


def in_raster(x: Column, y: Column, min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """Half-open on both axes."""
    return (x >= min_x) & (x < max_x) & (y >= min_y) & (y < max_y)


def orientation(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Twice the signed area of a, b, c: positive if c lies to the left of a -> b."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def points_equal(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (F.abs(ax - bx) <= POINT_TOLERANCE) & (F.abs(ay - by) <= POINT_TOLERANCE)


def pair_key(a: Column, b: Column) -> Column:
    """One key for an undirected pair of node ids."""
    a, b = a.cast("long"), b.cast("long")
    return F.shiftleft(F.least(a, b), 32).bitwiseOR(F.greatest(a, b))


def normalize_portal(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Struct (ax, ay, bx, by) with the end of lower longitude, then latitude, first."""
    swap = (ax > bx) | ((ax == bx) & (ay > by))
    pick = lambda p, q: F.when(swap, q).otherwise(p)
    return F.struct(pick(ax, bx).alias("ax"), pick(ay, by).alias("ay"), pick(bx, ax).alias("bx"), pick(by, ay).alias("by"))


def order_portal(fx: Column, fy: Column, tx: Column, ty: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Struct (left_x, left_y, right_x, right_y) as seen when going from f to t."""
    keep = orientation(fx, fy, tx, ty, ax, ay) >= 0
    pick = lambda p, q: F.when(keep, p).otherwise(q)
    return F.struct(pick(ax, bx).alias("left_x"), pick(ay, by).alias("left_y"), pick(bx, ax).alias("right_x"), pick(by, ay).alias("right_y"))


def bit_lsb(byte: Column, i: Column) -> Column:
    """Bit i of a byte, least significant first (portal bitsets)."""
    return F.getbit(byte.cast("long"), i.cast("int")).cast("int")


def bit_msb(byte: Column, i: Column) -> Column:
    """Bit i of a byte, most significant first (land masks)."""
    return F.getbit(byte.cast("long"), (F.lit(7) - i).cast("int")).cast("int")


def h3_hex_to_long(text: Column) -> Column:
    """Unsigned hexadecimal text as the signed 64-bit value of the same bits; null if it is not such text."""
    return F.when(text.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(text, 16, -10).cast("long"))


MODES = ("raw", "shortcut", "funnel")
ALGORITHMS = {"dijkstra": "dijkstra", "bidirectionalastar": "bidirectional-a-star"}


def parse_mode(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin(*MODES), low)


def resolve_mode(requested: Column, default: Column) -> Column:
    """The requested geometry mode, else the configured one, else funnel. Numbers are not names."""
    return F.coalesce(parse_mode(requested), parse_mode(default), F.lit("funnel"))


def parse_algorithm(text: Column) -> Column:
    low = F.replace(F.lower(F.trim(text)), F.lit("-"), F.lit(""))
    out = F.lit(None).cast("string")
    for key, name in ALGORITHMS.items():
        out = F.when(low == key, F.lit(name)).otherwise(out)
    return out


def resolve_algorithm(requested: Column, default: Column) -> Column:
    return F.coalesce(parse_algorithm(requested), parse_algorithm(default), F.lit("bidirectional-a-star"))


def clamp_iterations(requested: Column, default: int) -> Column:
    return F.least(F.greatest(F.coalesce(requested, F.lit(default)), F.lit(1)), F.lit(50))


def eta_label(distance_nm: Column) -> Column:
    """``~2d 5h`` at cruising speed; ``~5h`` under a day."""
    hours = _d(distance_nm) / F.lit(CRUISE_KNOTS)
    days = F.floor(hours / 24)
    rest = F.floor(hours - days * 24 + F.lit(0.5)).cast("long")
    return F.when(days > 0, F.concat(F.lit("~"), days.cast("string"), F.lit("d "), rest.cast("string"), F.lit("h"))).otherwise(F.concat(F.lit("~"), rest.cast("string"), F.lit("h")))


def coord_label(lat: Column, lon: Column) -> Column:
    """Two decimals and hemisphere letters."""
    part = lambda v, pos, neg: F.concat(F.format_string("%.2f", F.abs(_d(v))), F.lit("°"), F.when(v >= 0, F.lit(pos)).otherwise(F.lit(neg)))
    return F.concat(part(lat, "N", "S"), F.lit(" "), part(lon, "E", "W"))
