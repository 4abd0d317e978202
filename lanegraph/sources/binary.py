"""Readers of the binary artifacts.

A graph file is read in slices: each task opens the file (a local path, or any URI that ``pyarrow.fs``
knows) and reads its own range of every array, so neither its size nor the driver's memory limits it. The
others are small; Spark fetches them whole (``binaryFile``) and they are decoded in Arrow batches.
Integers and floats are little-endian. A file that breaks a rule of its layout raises ``ArtifactError``.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanegraph import schemas
from lanegraph.functions.hexagons import cell_centres, shared_edges
from lanegraph.operators.raster import Raster
from lanegraph.shared import spread

# Fixed values of the layouts.
GRAPH_MAGIC = b"OCNCSR1\0"
PORTAL_MAGIC = b"OCNPRTL1"
MASK_MAGIC = b"OCNLMSK1"
HINT_MAGIC = b"OCNAISH1"
GRAPH_HEADER_BYTES = 96
PORTAL_HEADER_BYTES = 52
DELTA_OVERFLOW = -32768
ROWS = 100_000


class ArtifactError(ValueError):
    """A file does not follow its layout."""


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise ArtifactError(why)


def _unpack(fmt: str, data: bytes, at: int = 0) -> tuple:
    _need(at + struct.calcsize(fmt) <= len(data), "file is cut short")
    return struct.unpack_from(fmt, data, at)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    _need(len(rows) == 1, f"{path} is not one file")
    return bytes(rows[0]["content"])


def artifact_hash(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 in lower-case hex of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def check_hash(data: bytes, expected: str | None) -> None:
    if expected is not None:
        _need(hashlib.sha256(data).hexdigest() == expected.strip().lower(), "file does not have the expected SHA-256")


# --- graph ----------------------------------------------------------------------------------


ARRAYS = {"h3": "<i8", "component": "<i4", "node_class": "u1", "degree": "u1", "delta": "<i2", "cost": "<f4", "position": "<u4", "target": "<u4"}


def graph_layout(head: bytes, size: int) -> dict:
    """Counts, resolution and the offset and length of every array, from the first bytes of a graph file of ``size`` bytes."""
    _need(size >= GRAPH_HEADER_BYTES and len(head) >= GRAPH_HEADER_BYTES, "graph file is cut short")
    _need(head[:8] == GRAPH_MAGIC, "not a graph file")
    version, resolution, n, e, *offsets = _unpack("<IIqq8q", head, 8)
    _need(version == 1, f"graph version {version} is unknown")
    _need(0 <= n < 2**31 and 0 <= e < 2**31, "graph counts are out of range")
    _need(offsets[0] == GRAPH_HEADER_BYTES and offsets == sorted(offsets) and offsets[-1] <= size, "graph offsets are out of order")
    ends = [*offsets[1:], size]
    spare = (ends[7] - offsets[6]) // 8
    counts = dict(zip(ARRAYS, (n, n, n, n, e, e, spare, spare)))
    for (name, kind), lo, hi in zip(ARRAYS.items(), offsets, ends):
        _need(hi - lo == np.dtype(kind).itemsize * counts[name], "a graph array has the wrong length")
    return {"nodes": n, "edges": e, "resolution": resolution, "offset": dict(zip(ARRAYS, offsets)), "count": counts}


def open_file(path: str) -> pa.NativeFile:
    """A file that is read by ranges: a local path, or any URI that ``pyarrow.fs`` knows."""
    fs, place = pafs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(place)


class Slices:
    """An open graph file whose arrays are read by ranges."""

    def __init__(self, path: str, file=None):
        self.file = file or open_file(path)
        self.size = self.file.size()
        self.layout = graph_layout(self.file.read_at(min(self.size, GRAPH_HEADER_BYTES), 0), self.size)

    def __getitem__(self, key: tuple[str, int, int]) -> np.ndarray:
        name, lo, hi = key
        kind = np.dtype(ARRAYS[name])
        data = self.file.read_at(kind.itemsize * (hi - lo), self.layout["offset"][name] + kind.itemsize * lo)
        return np.frombuffer(data, kind)

    def overflow_from(self, edge: int) -> int:
        """Index of the first overflow entry at or after an edge; the entries are in edge order."""
        return bisect.bisect_left(range(self.layout["count"]["position"]), edge, key=lambda i: int(self["position", i, i + 1][0]))

    def edges(self, nodes: tuple[int, int], first: int) -> dict[str, np.ndarray]:
        """edge_id, src, dst, cost of the edges that leave a range of nodes, the first of which is edge ``first``."""
        degree = self["degree", *nodes].astype(np.int64)
        last = first + int(degree.sum())
        src = np.repeat(np.arange(*nodes, dtype=np.int64), degree)
        delta = self["delta", first, last]
        dst = src + delta
        far = np.flatnonzero(delta == DELTA_OVERFLOW)
        a, b = self.overflow_from(first), self.overflow_from(last)
        listed = self["position", max(a - 1, 0), min(b + 1, self.layout["count"]["position"])].astype(np.int64)
        _need(bool((np.diff(listed) > 0).all()), "overflow targets are out of order")
        _need(np.array_equal(far + first, self["position", a, b].astype(np.int64)), "overflow targets do not match their edges")
        dst[far] = self["target", a, b]
        _need(bool(((dst >= 0) & (dst < self.layout["nodes"])).all()), "an edge leads out of the graph")
        return {"edge_id": np.arange(first, last, dtype=np.int64), "src": src, "dst": dst, "cost": self["cost", first, last]}


def encode_graph(h3, component, node_class, src, dst, cost, resolution: int = 5) -> bytes:
    """A graph file of edges sorted by source."""
    n, e = len(h3), len(src)
    degree = np.bincount(np.asarray(src, np.int64), minlength=n)
    delta = np.asarray(dst, np.int64) - np.asarray(src, np.int64)
    far = np.abs(delta) > 32767
    parts = [
        np.asarray(h3, "<i8"), np.asarray(component, "<i4"), np.asarray(node_class, "u1"), degree.astype("u1"),
        np.where(far, DELTA_OVERFLOW, delta).astype("<i2"), np.asarray(cost, "<f4"),
        np.flatnonzero(far).astype("<u4"), np.asarray(dst, np.int64)[far].astype("<u4"),
    ]
    offsets, at = [], GRAPH_HEADER_BYTES
    for p in parts:
        offsets.append(at)
        at += p.nbytes
    return GRAPH_MAGIC + struct.pack("<IIqq8q", 1, resolution, n, e, *offsets) + b"".join(p.tobytes() for p in parts)


def _decoded(spark: SparkSession, path: str, make: Callable[[bytes], list[tuple[list, int]]], schema: str, sha256: str | None) -> DataFrame:
    """Rows of one artifact: ``make`` gives its columns; batches of ROWS rows leave the task one after another."""
    files = spark.read.format("binaryFile").load(path).select("content")
    target = spark.createDataFrame([], schema).schema
    kinds = [pa.field(f.name, _arrow(f.dataType)) for f in target]

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                check_hash(data, sha256)
                columns = make(data)
                for lo in range(0, len(columns[0]), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + ROWS], k.type) for c, k in zip(columns, kinds)], names=[k.name for k in kinds])

    return files.mapInArrow(run, schema)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _hash_gate(spark: SparkSession, path: str, expected: str | None) -> None:
    """A file's hash depends on its bytes in order, so one task streams it."""
    if expected is None:
        return

    def run(batches):
        for _ in batches:
            file, total = Slices(path).file, hashlib.sha256()
            file.seek(0)
            while chunk := file.read(1 << 22):
                total.update(chunk)
            yield pa.RecordBatch.from_arrays([pa.array([total.hexdigest()])], names=["sha256"])

    found = spark.range(1, numPartitions=1).mapInArrow(run, "sha256 string").first()[0]
    _need(found == expected.strip().lower(), "file does not have the expected SHA-256")


def _ranges(spark: SparkSession, path: str, slices: int | None) -> tuple[dict, DataFrame, Callable[[int], tuple[int, int]]]:
    """The layout, a row per slice (each a partition), and the slice's range of nodes."""
    layout = Slices(path).layout
    n = layout["nodes"]
    k = max(1, min(slices or spread(spark), n))
    return layout, spark.range(0, k, 1, k), lambda i: (n * i // k, n * (i + 1) // k)


def read_nodes(spark: SparkSession, path: str, centers: DataFrame | None = None, sha256: str | None = None, slices: int | None = None) -> DataFrame:
    """Nodes of a graph file, in ``slices`` tasks. Their coordinates are their cells' centres (null for a number that is no cell), or those of ``centers`` (h3_int, lat, lon)."""
    _hash_gate(spark, path, sha256)
    _, rows, nodes = _ranges(spark, path, slices)
    own = centers is None

    def run(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                file, (lo, hi) = Slices(path), nodes(i)
                for at in range(lo, hi, ROWS):
                    part = at, min(at + ROWS, hi)
                    cells = file["h3", *part]
                    place = [pa.array(c.astype(np.float32), mask=np.isnan(c)) for c in cell_centres(cells)] if own else []
                    columns = [np.arange(*part, dtype=np.int32), cells, file["component", *part], file["node_class", *part].astype(np.int16)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns] + place, names=["node_id", "h3_int", "component_id", "node_class", *["lat", "lon"][: len(place)]])

    found = rows.mapInArrow(run, "node_id int, h3_int long, component_id int, node_class short" + (", lat float, lon float" if own else ""))
    if not own:
        found = found.join(centers.select("h3_int", F.col("lat").cast("float"), F.col("lon").cast("float")), "h3_int", "left")
    return found.select("node_id", "h3_int", "lat", "lon", "component_id", "node_class")


def read_edges(spark: SparkSession, path: str, sha256: str | None = None, slices: int | None = None) -> DataFrame:
    """Edges of a graph file, in ``slices`` tasks: first each slice's degrees are summed, then each reads the edges of its nodes."""
    _hash_gate(spark, path, sha256)
    layout, rows, nodes = _ranges(spark, path, slices)

    def total(batches):
        for b in batches:
            found = [int(Slices(path)["degree", *nodes(i)].sum(dtype=np.int64)) for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], names=["slice", "n"])

    sums = sorted(rows.mapInArrow(total, "slice long, n long").collect())  # a row per slice
    first = np.concatenate([[0], np.cumsum([n for _, n in sums])]).tolist()
    _need(first[-1] == layout["edges"], "degrees do not add up to the number of edges")

    def run(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                e = Slices(path).edges(nodes(i), first[i])
                columns = [e["edge_id"].astype(np.int32), e["src"].astype(np.int32), e["dst"].astype(np.int32), e["cost"]]
                for lo in range(0, len(columns[0]), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + ROWS]) for c in columns], names=["edge_id", "src", "dst", "cost"])

    found = rows.mapInArrow(run, "edge_id int, src int, dst int, cost float")
    kinds = spark.createDataFrame([], schemas.EDGES).schema
    return found.select(*[F.col(f.name) if f.name in found.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds])


# --- portals --------------------------------------------------------------------------------


def decode_portals(data: bytes, edge_count: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edge ids that have a portal, whether each is explicit, and (n, 4) ends (NaN where implicit)."""
    _need(data[:8] == PORTAL_MAGIC, "not a portal file")
    version, edges, explicit, unique, has_bytes, explicit_bytes, index_size, record_size = _unpack("<IQQQIIII", data, 8)
    _need(version == 1 and index_size == 4 and record_size == 16, "portal layout is unknown")
    _need(edge_count is None or edges == edge_count, "portals are for another graph")
    need = -(-edges // 8)
    _need(has_bytes >= need and explicit_bytes >= need, "portal bitsets are too short")
    at = PORTAL_HEADER_BYTES
    body = at + has_bytes + explicit_bytes
    _need(len(data) == body + 4 * explicit + 16 * unique, "portal file has the wrong length")
    bits = lambda lo: np.unpackbits(np.frombuffer(data, np.uint8, need, lo), bitorder="little")[:edges].astype(bool)
    has, own = bits(at), bits(at + has_bytes)
    _need(int(own.sum()) == explicit, "explicit portals do not match their bitset")
    index = np.frombuffer(data, "<u4", explicit, body)
    payload = np.frombuffer(data, "<f4", 4 * unique, body + 4 * explicit).reshape(-1, 4)
    _need(bool((index < max(unique, 1)).all()) if explicit else True, "a portal index is out of range")
    ends = np.full((edges, 4), np.nan)
    ends[own] = payload[index]
    at_edges = np.flatnonzero(has)
    return at_edges, own[has], ends[has]


def encode_portals(has: np.ndarray, explicit: np.ndarray, index: np.ndarray, payload: np.ndarray) -> bytes:
    pack = lambda b: np.packbits(np.asarray(b, np.uint8), bitorder="little").tobytes()
    a, b = pack(has), pack(explicit)
    head = PORTAL_MAGIC + struct.pack("<IQQQIIII", 1, len(has), int(np.sum(explicit)), len(payload), len(a), len(b), 4, 16)
    return head + a + b + np.asarray(index, "<u4").tobytes() + np.asarray(payload, "<f4").tobytes()


def implicit_portals(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edge_id, ax, ay, bx, by: the side that the cells of an edge's two nodes share, for edges between neighbours. Both directions give the same."""
    cell = nodes.select("node_id", F.col("h3_int"))
    both = edges.select("edge_id", "src", "dst").join(cell.toDF("src", "a"), "src").join(cell.toDF("dst", "b"), "dst")

    def run(batches):
        for b in batches:
            found = shared_edges(b.column(1).to_numpy(), b.column(2).to_numpy())
            ok = np.flatnonzero(~np.isnan(found[:, 0]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), *(pa.array(found[ok, i]) for i in range(4))], names=["edge_id", "ax", "ay", "bx", "by"])

    pairs = both.select(F.col("edge_id").cast("int"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.mapInArrow(run, "edge_id int, ax double, ay double, bx double, by double")


def read_portals(spark: SparkSession, path: str, edge_count: int | None = None, implicit: DataFrame | None = None, sha256: str | None = None) -> DataFrame:
    """Portals by edge. Implicit ones follow from cell boundaries, which ``implicit`` (edge_id, ax, ay, bx, by; see ``implicit_portals``) must give; one that is missing fails the query."""

    def make(data: bytes):
        edges, own, ends = decode_portals(data, edge_count)
        return [edges.astype(np.int32), own, *(pa.array(ends[:, i], mask=~own) for i in range(4))]

    found = _decoded(spark, path, make, schemas.PORTALS, sha256)
    given = implicit if implicit is not None else spark.createDataFrame([], "edge_id int, ax double, ay double, bx double, by double")
    both = found.alias("p").join(given.alias("i"), "edge_id", "left")
    lost = ~F.col("p.is_explicit") & F.col("i.ax").isNull()
    pick = lambda c: F.when(lost, F.raise_error(F.lit("an implicit portal has no boundary")).cast("double")).otherwise(F.coalesce(F.col(f"p.{c}"), F.col(f"i.{c}"))).alias(c)
    return both.select("edge_id", "p.is_explicit", *[pick(c) for c in ("ax", "ay", "bx", "by")])


# --- land mask ------------------------------------------------------------------------------


def decode_mask(data: bytes) -> tuple[dict, list[tuple[int, int, bytes]]]:
    """Header fields and (tile_index, land_pixel_count, payload as stored) of versions 1 to 3; version 1 is one tile."""
    _need(data[:8] == MASK_MAGIC, "not a land mask")
    version, w, h, pixel, min_x, min_y, max_x, max_y, dilation = _unpack("<III5dI", data, 8)
    at = 8 + struct.calcsize("<III5dI")
    meta = {"width": w, "height": h, "pixel_size_m": pixel, "min_x": min_x, "min_y": min_y, "max_x": max_x, "max_y": max_y, "dilation_pixels": dilation}
    _need(w > 0 and h > 0 and pixel > 0, "mask sizes must be positive")
    if version == 1:
        (bits,) = _unpack("<Q", data, at)
        body = data[at + 8 :]
        _need(bits == w * h and len(body) == -(-bits // 8), "mask bits have the wrong length")
        count = int(np.unpackbits(np.frombuffer(body, np.uint8))[:bits].sum())
        return meta | {"tile_w": w, "tile_h": h, "tile_cols": 1, "tile_rows": 1, "codec": 0}, [(0, count, body)]
    _need(version in (2, 3), f"mask version {version} is unknown")
    tw, th, cols, rows = _unpack("<IIII", data, at)
    at += 16
    codec = 0
    if version == 3:
        (codec,) = _unpack("<I", data, at)
        at += 4
    _need(codec in (0, 1), "mask codec is unknown")
    (bits,) = _unpack("<Q", data, at)
    at += 8
    _need(bits == w * h and tw > 0 and th > 0 and cols == -(-w // tw) and rows == -(-h // th), "mask tiles do not cover the mask")
    entry = "<QIII" if version == 3 else "<QII"
    tiles = []
    for i in range(cols * rows):
        values = _unpack(entry, data, at + i * struct.calcsize(entry))
        offset, length, land = values[0], values[1], values[-1]
        _need(offset + length <= len(data), "a mask tile lies outside the file")
        tiles.append((i, land, data[offset : offset + length]))
        if version == 3 and length:
            raw = zlib.decompress(tiles[-1][2]) if codec == 1 and values[2] else tiles[-1][2]
            _need(not values[2] or len(raw) == values[2], "a mask tile has the wrong length")
    return meta | {"tile_w": tw, "tile_h": th, "tile_cols": cols, "tile_rows": rows, "codec": codec}, tiles


def read_mask(spark: SparkSession, path: str, sha256: str | None = None) -> Raster:
    """A mask to walk on; tiles stay compressed."""
    data = read_bytes(spark, path)
    check_hash(data, sha256)
    meta, tiles = decode_mask(data)
    return Raster(meta["width"], meta["height"], meta["pixel_size_m"], meta["min_x"], meta["min_y"], meta["max_x"], meta["max_y"], None, (meta["tile_w"], meta["tile_h"]), {i: p for i, _, p in tiles}, meta["codec"])


def read_mask_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The header as one row, and the tiles."""
    meta, tiles = decode_mask(read_bytes(spark, path))
    names = [p.split()[0] for p in schemas.MASK_META.split(", ")]
    return spark.createDataFrame([tuple(meta[k] for k in names)], schemas.MASK_META), spark.createDataFrame(tiles, schemas.MASK_TILES)


class MaskFile:
    """An open mask file whose tiles are read by ranges. Version 1, one bit array, is cut into bands of rows that end at whole bytes."""

    def __init__(self, path: str, band_bytes: int = 1 << 20):
        self.file = open_file(path)
        self.size = self.file.size()
        head = self.file.read_at(min(self.size, 128), 0)
        _need(head[:8] == MASK_MAGIC, "not a land mask")
        fixed = "<III5dI"
        version, w, h, pixel, min_x, min_y, max_x, max_y, dilation = _unpack(fixed, head, 8)
        at = 8 + struct.calcsize(fixed)
        _need(w > 0 and h > 0 and pixel > 0, "mask sizes must be positive")
        _need(version in (1, 2, 3), f"mask version {version} is unknown")
        codec = 0
        if version == 1:
            rows = max(8, band_bytes * 8 // w // 8 * 8)
            tw, th, cols, down = w, min(rows, h), 1, -(-h // min(rows, h))
        else:
            tw, th, cols, down = _unpack("<IIII", head, at)
            at += 16
            _need(tw > 0 and th > 0 and cols == -(-w // tw) and down == -(-h // th), "mask tiles do not cover the mask")
            if version == 3:
                (codec,) = _unpack("<I", head, at)
                at += 4
        _need(codec in (0, 1), "mask codec is unknown")
        (bits,) = _unpack("<Q", head, at)
        _need(bits == w * h and (version > 1 or self.size == at + 8 + -(-bits // 8)), "mask bits have the wrong length")
        self.version, self.directory = version, at + 8
        self.entry = {1: "", 2: "<QII", 3: "<QIII"}[version]
        box = {"min_x": min_x, "min_y": min_y, "max_x": max_x, "max_y": max_y}
        self.meta = {"width": w, "height": h, "pixel_size_m": pixel, **box, "dilation_pixels": dilation, "tile_w": tw, "tile_h": th, "tile_cols": cols, "tile_rows": down, "codec": codec}

    def tiles(self, lo: int, hi: int) -> Iterator[tuple[int, int, bytes]]:
        """(tile_index, land_pixel_count, payload as stored) of a range of tiles."""
        if self.version == 1:
            w, h, band = self.meta["width"], self.meta["height"], self.meta["tile_h"]
            for i in range(lo, hi):
                cells = w * min(band, h - i * band)
                data = self.file.read_at(-(-cells // 8), self.directory + i * band * w // 8)
                yield i, int(np.unpackbits(np.frombuffer(data, np.uint8))[:cells].sum()), data
            return
        size = struct.calcsize(self.entry)
        listed = self.file.read_at(size * (hi - lo), self.directory + size * lo)
        for i in range(lo, hi):
            offset, length, *rest = _unpack(self.entry, listed, size * (i - lo))
            _need(offset + length <= self.size, "a mask tile lies outside the file")
            data = self.file.read_at(length, offset)
            if self.version == 3 and length and rest[0]:
                _need(len(zlib.decompress(data) if self.meta["codec"] == 1 else data) == rest[0], "a mask tile has the wrong length")
            yield i, rest[-1], data


def read_mask_tiles(spark: SparkSession, path: str, slices: int | None = None, band_bytes: int = 1 << 20) -> tuple[dict, DataFrame]:
    """Header fields, and the tiles, read by ranges in ``slices`` tasks; the driver reads the header alone. Bands of version 1 have about ``band_bytes``."""
    meta = MaskFile(path, band_bytes).meta
    n = meta["tile_cols"] * meta["tile_rows"]
    k = max(1, min(slices or spread(spark), n))

    def run(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                for tile in MaskFile(path, band_bytes).tiles(n * i // k, n * (i + 1) // k):
                    yield pa.RecordBatch.from_arrays([pa.array([tile[0]], pa.int32()), pa.array([tile[1]], pa.int32()), pa.array([tile[2]], pa.binary())], names=["tile_index", "land_pixel_count", "payload"])

    return meta, spark.range(0, k, 1, k).mapInArrow(run, schemas.MASK_TILES)


def land_cells(tiles: DataFrame, meta: dict) -> DataFrame:
    """(row, col) of every land cell, decoded tile by tile on the executors."""

    def run(batches):
        for b in batches:
            for index, payload in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if not payload:
                    continue
                raw = zlib.decompress(payload) if meta["codec"] == 1 else payload
                tr, tc = divmod(index, meta["tile_cols"])
                w, h = min(meta["tile_w"], meta["width"] - tc * meta["tile_w"]), min(meta["tile_h"], meta["height"] - tr * meta["tile_h"])
                at = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8))[: w * h])
                yield pa.RecordBatch.from_arrays([pa.array((at // w + tr * meta["tile_h"]).astype(np.int32)), pa.array((at % w + tc * meta["tile_w"]).astype(np.int32))], names=["row", "col"])

    return tiles.mapInArrow(run, "row int, col int")


# --- hints ----------------------------------------------------------------------------------


def decode_hints(data: bytes) -> list[tuple]:
    _need(data[:8] == HINT_MAGIC, "not a hint file")
    version, count = _unpack("<II", data, 8)
    _need(version == 1, f"hint version {version} is unknown")
    at, out, fixed = 16, [], "<i16sBBHfIII4f"
    for _ in range(count):
        cid, code, kind, flags, _, confidence, support, points, spans, *box = _unpack(fixed, data, at)
        at += struct.calcsize(fixed)
        xy = _unpack(f"<{2 * points}f", data, at)
        at += 8 * points
        ids = _unpack(f"<{2 * spans}I", data, at)
        at += 8 * spans
        text = code.split(b"\0", 1)[0].decode("ascii", "replace")
        out.append((cid, text, kind, flags, confidence, support, list(zip(xy[::2], xy[1::2])), list(zip(ids[::2], ids[1::2])), *map(float, box)))
    _need(at == len(data), "hint file has bytes left over")
    return out


def encode_hints(rows: list[tuple]) -> bytes:
    out = [HINT_MAGIC + struct.pack("<II", 1, len(rows))]
    for cid, code, kind, flags, confidence, support, coords, spans, *box in rows:
        out.append(struct.pack("<i16sBBHfIII4f", cid, code.encode("ascii"), kind, flags, 0, confidence, support, len(coords), len(spans), *box))
        out += [struct.pack("<ff", *c) for c in coords] + [struct.pack("<II", *s) for s in spans]
    return b"".join(out)


def read_hints(spark: SparkSession, path: str, sha256: str | None = None, position: bool = False) -> DataFrame:
    """Hints of a file; ``position`` adds their place in it, which decides between equal ones."""

    def make(data: bytes):
        columns = [list(c) for c in zip(*decode_hints(data))] or [[] for _ in range(12)]
        columns += [list(range(len(columns[0])))] if position else []
        columns[6] = [[{"lon": x, "lat": y} for x, y in c] for c in columns[6]]
        columns[7] = [[{"src": a, "dst": b} for a, b in s] for s in columns[7]]
        return columns

    return _decoded(spark, path, make, schemas.HINTS + (", position int" if position else ""), sha256)
