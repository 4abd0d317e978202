"""Land masks: cells as rows for joins, packed bits for walks along segments."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanegraph.functions.geo import EARTH_RADIUS_M, MAX_MERCATOR_LAT, in_raster, mercator_x, mercator_y, raster_col, raster_row

CORNER_TOLERANCE = 1e-12
#: A packed mask of at most so many cells is opened to a byte a cell in each worker that walks it.
MAX_OPEN_CELLS = 1 << 24


class Raster:
    """A land mask in Web Mercator: one packed grid, or tiles that stay compressed until they are touched."""

    def __init__(self, width: int, height: int, pixel: float, min_x: float, min_y: float, max_x: float, max_y: float, bits: bytes | None = None, tile: tuple[int, int] | None = None, tiles: dict[int, bytes] | None = None, codec: int = 0):
        if width <= 0 or height <= 0 or pixel <= 0:
            raise ValueError("mask sizes must be positive")
        if bits is not None and len(bits) != -(-width * height // 8):
            raise ValueError("packed mask has the wrong length")
        self.width, self.height, self.pixel = width, height, pixel
        self.min_x, self.min_y, self.max_x, self.max_y = min_x, min_y, max_x, max_y
        self.bits, self.tile, self.tiles, self.codec = bits, tile, tiles or {}, codec
        self.open: dict[int, bytes] = {}
        self.framed: np.ndarray | None = None

    @classmethod
    def from_cells(cls, width, height, pixel, min_x, min_y, max_x, max_y, rows: np.ndarray, cols: np.ndarray) -> "Raster":
        grid = np.zeros(width * height, np.uint8)
        grid[rows * width + cols] = 1
        return cls(width, height, pixel, min_x, min_y, max_x, max_y, np.packbits(grid).tobytes())

    def __getstate__(self):
        return {**self.__dict__, "open": {}, "framed": None}

    def land_many(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """``land`` of many cells at once."""
        out = np.ones(len(row), bool)
        inside = np.flatnonzero((row >= 0) & (row < self.height) & (col >= 0) & (col < self.width))
        r, c = row[inside], col[inside]
        if self.bits is not None:
            at = r * self.width + c
            out[inside] = np.frombuffer(self.bits, np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
        else:
            tw, th = self.tile
            across = -(-self.width // tw)
            index = r // th * across + c // tw
            for k in np.unique(index).tolist():
                i = np.flatnonzero(index == k)
                data = self._tile(k)
                if data:
                    tr, tc = divmod(k, across)
                    at = (r[i] - tr * th) * min(tw, self.width - tc * tw) + c[i] - tc * tw
                    out[inside[i]] = np.frombuffer(data, np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
                else:  # an empty tile is water
                    out[inside[i]] = False
        return out

    def _framed(self) -> np.ndarray:
        """Land by cell in one row after the other, with a frame of land around the grid; made once per worker."""
        if self.framed is None:
            grid = np.ones((self.height + 2, self.width + 2), bool)
            grid[1:-1, 1:-1] = np.unpackbits(np.frombuffer(self.bits, np.uint8))[: self.width * self.height].reshape(self.height, self.width)
            self.framed = grid.ravel()
        return self.framed

    def _tile(self, index: int) -> bytes:
        data = self.open.get(index)
        if data is None:
            raw = self.tiles.get(index, b"")
            data = self.open[index] = zlib.decompress(raw) if raw and self.codec == 1 else raw
        return data

    def land(self, row: int, col: int) -> bool:
        """Land, or outside the grid."""
        return bool(self.land_many(np.array([row]), np.array([col]))[0])

    def project(self, lon, lat):
        lat = np.clip(lat, -MAX_MERCATOR_LAT, MAX_MERCATOR_LAT)
        return EARTH_RADIUS_M * lon * math.pi / 180.0, EARTH_RADIUS_M * np.log(np.tan(math.pi / 4 + lat * math.pi / 360.0))

    def cell(self, x: float, y: float) -> tuple[int, int] | None:
        """(row, col) of a projected point; None outside."""
        if not (self.min_x <= x < self.max_x and self.min_y <= y < self.max_y):
            return None
        col = min(max(int((x - self.min_x) / self.pixel), 0), self.width - 1)
        return min(max(int((self.max_y - y) / self.pixel), 0), self.height - 1), col

    def touched(self, start: tuple[float, float], end: tuple[float, float]):
        """Cells from start to end (lon, lat) in order. Through a corner both cells beside it come before the diagonal one. None: outside."""
        (x0, y0), (x1, y1) = (tuple(map(float, self.project(*p))) for p in (start, end))
        a, b = self.cell(x0, y0), self.cell(x1, y1)
        if a is None or b is None:
            yield None
            return
        row, col = a
        yield row, col
        dx, dy = x1 - x0, y1 - y0
        right, down = (dx > 0) - (dx < 0), (dy < 0) - (dy > 0)
        # Share of the segment at which the next column or row begins, and the share that one takes.
        every_x = self.pixel / abs(dx) if right else math.inf
        every_y = self.pixel / abs(dy) if down else math.inf
        at_x = (self.min_x + (col + (right > 0)) * self.pixel - x0) / dx if right else math.inf
        at_y = (self.max_y - (row + (down > 0)) * self.pixel - y0) / dy if down else math.inf
        while (row, col) != b:
            corner = abs(at_x - at_y) <= CORNER_TOLERANCE
            if corner:
                if right:
                    yield row, col + right
                if down:
                    yield row + down, col
            go_x, go_y = corner or at_x < at_y, corner or at_x >= at_y
            if go_x:
                col, at_x = col + right, at_x + every_x
            if go_y:
                row, at_y = row + down, at_y + every_y
            yield row, col

    def safe(self, start: tuple[float, float], end: tuple[float, float]) -> bool:
        return bool(self.safe_many(np.array([start], float), np.array([end], float))[0])

    def safe_many(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """No land on the way from each (lon, lat) to the other; segments over the anti-meridian or out of the grid are not safe.

        All segments walk side by side, one cell a step, until they arrive or meet land; the cells are those of ``touched``.
        """
        (x0, y0), (x1, y1) = self.project(start[:, 0], start[:, 1]), self.project(end[:, 0], end[:, 1])
        within = lambda x, y: (x >= self.min_x) & (x < self.max_x) & (y >= self.min_y) & (y < self.max_y)
        out = (np.abs(end[:, 0] - start[:, 0]) <= 180.0) & within(x0, y0) & within(x1, y1)
        who = np.flatnonzero(out)
        x0, y0, x1, y1 = x0[who], y0[who], x1[who], y1[who]
        at = lambda v, low, n: np.clip(((v - low) / self.pixel).astype(np.int64), 0, n - 1)
        row, col, row1, col1 = at(self.max_y, y0, self.height), at(x0, self.min_x, self.width), at(self.max_y, y1, self.height), at(x1, self.min_x, self.width)
        dx, dy = x1 - x0, y1 - y0
        right, down = np.sign(dx).astype(np.int64), -np.sign(dy).astype(np.int64)
        with np.errstate(divide="ignore", invalid="ignore"):
            every_x, every_y = np.where(right, self.pixel / np.abs(dx), np.inf), np.where(down, self.pixel / np.abs(dy), np.inf)
            at_x = np.where(right, (self.min_x + (col + (right > 0)) * self.pixel - x0) / dx, np.inf)
            at_y = np.where(down, (self.max_y - (row + (down > 0)) * self.pixel - y0) / dy, np.inf)
        if self.bits is not None and self.width * self.height <= MAX_OPEN_CELLS:
            across = self.width + 2
            return self._walk_framed(out, who, (row + 1) * across + col + 1, (row1 + 1) * across + col1 + 1, right, down * across, every_x, every_y, at_x, at_y)
        land = self.land_many(row, col)
        while True:
            out[who[land]] = False
            go = np.flatnonzero(~land & ((row != row1) | (col != col1)))
            if not len(go):
                return out
            if len(go) < len(who):
                who, row, col, row1, col1, right, down, every_x, every_y, at_x, at_y = (v[go] for v in (who, row, col, row1, col1, right, down, every_x, every_y, at_x, at_y))
            with np.errstate(invalid="ignore"):
                corner = np.abs(at_x - at_y) <= CORNER_TOLERANCE
            land = np.zeros(len(who), bool)
            for beside, r, c in ((corner & (right != 0), row, col + right), (corner & (down != 0), row + down, col)):
                if beside.any():
                    land[beside] |= self.land_many(r[beside], c[beside])
            go_x, go_y = corner | (at_x < at_y), corner | (at_x >= at_y)
            col, row = col + right * go_x, row + down * go_y
            at_x, at_y = np.where(go_x, at_x + every_x, at_x), np.where(go_y, at_y + every_y, at_y)
            land |= self.land_many(row, col)

    def _walk_framed(self, out: np.ndarray, who, at, end, right, down, every_x, every_y, at_x, at_y) -> np.ndarray:
        """The same walk by places in the framed mask. Segments that have ended stand still until enough have to be dropped."""
        grid = self._framed()
        land = grid[at]
        while True:
            out[who[land]] = False
            go = ~land & (at != end)
            left = np.count_nonzero(go)
            if not left:
                return out
            if left < 0.75 * len(who):
                who, at, end, right, down, every_x, every_y, at_x, at_y = (v[go] for v in (who, at, end, right, down, every_x, every_y, at_x, at_y))
            elif left < len(who):
                ended = np.flatnonzero(~go)
                right[ended] = down[ended] = 0
                at[ended] = end[ended]  # land beside a corner is not where they are
            with np.errstate(invalid="ignore"):
                corner = np.abs(at_x - at_y) <= CORNER_TOLERANCE
            go_x, go_y = at_x < at_y, at_x >= at_y
            beside = None
            if corner.any():
                beside = grid[at + right] | grid[at + down]
                beside &= corner & ((right != 0) | (down != 0))
                go_x, go_y = corner | go_x, corner | go_y
            at = at + right * go_x + down * go_y
            at_x, at_y = np.where(go_x, at_x + every_x, at_x), np.where(go_y, at_y + every_y, at_y)
            land = grid[at] if beside is None else grid[at] | beside


def located(points: DataFrame, meta: dict) -> DataFrame:
    """Points (lon, lat) with inside, row and col in the mask described by ``meta``."""
    x, y = mercator_x(F.col("lon")), mercator_y(F.col("lat"))
    inside = in_raster(x, y, *[F.lit(float(meta[k])) for k in ("min_x", "min_y", "max_x", "max_y")])
    pixel = F.lit(float(meta["pixel_size_m"]))
    row = raster_row(y, F.lit(float(meta["max_y"])), pixel, F.lit(meta["height"]))
    col = raster_col(x, F.lit(float(meta["min_x"])), pixel, F.lit(meta["width"]))
    return points.withColumns({"inside": inside, "row": F.when(inside, row), "col": F.when(inside, col)})


def land_at(points: DataFrame, meta: dict, land_cells: DataFrame) -> DataFrame:
    """``located`` with is_land: true outside, else whether the cell is among land_cells (row, col)."""
    at = located(points, meta)
    marked = land_cells.select("row", "col", F.lit(True).alias("hit"))
    return at.join(marked, ["row", "col"], "left").withColumn("is_land", ~F.col("inside") | F.coalesce("hit", F.lit(False))).drop("hit")


def segments_safe(segments: DataFrame, raster: Raster) -> DataFrame:
    """segment_id and safe of segments (segment_id, lon1, lat1, lon2, lat2). The mask has a fixed size (0.2 MB for a region) and is broadcast."""
    sent = segments.sparkSession.sparkContext.broadcast(raster)

    def run(batches):
        for b in batches:
            lon1, lat1, lon2, lat2 = (b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
            found = sent.value.safe_many(np.stack([lon1, lat1], 1), np.stack([lon2, lat2], 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], names=["segment_id", "safe"])

    cols = [F.col(c).cast("double") for c in ("lon1", "lat1", "lon2", "lat2")]
    return segments.select(F.col("segment_id").cast("long"), *cols).mapInArrow(run, "segment_id long, safe boolean")
