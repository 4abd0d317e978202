"""Artifacts as Spark data sources, read by ranges and pruned by filters.

    formats.register(spark)
    spark.read.format("lanegraph_edges").load(path).where("src between 100 and 200")

Formats: ``lanegraph_nodes`` (node_id, h3_int, component_id, node_class), ``lanegraph_edges`` (edge_id, src, dst, cost),
``lanegraph_portals`` (edge_id, is_explicit, ax, ay, bx, by; the ends are null where implicit) and ``lanegraph_hints``. The
driver streams what offsets follow from (degrees, bitsets, hint headers) and keeps one number for each partition; a task
opens the file and reads the ranges of its partition. The option ``rows`` sets how many rows a partition has about.

Filters that are answered here, so that less is read: comparisons of ``node_id``, ``edge_id``, ``src``, equality of
``component_id`` (other arrays of a block without it are not read) and, for hints, comparisons of the bounding box
(``min_lon``, ``min_lat``, ``max_lon``, ``max_lat``: the points and spans of other hints are skipped). All others are Spark's.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from lanegraph import schemas
from lanegraph.sources.binary import HINT_MAGIC, PORTAL_HEADER_BYTES, PORTAL_MAGIC, ROWS, Slices, _need, _unpack, open_file

PARTITION_ROWS = 1_000_000
CHUNK = 1 << 20


class Counted:
    """A file that counts the bytes read from it."""

    def __init__(self, path: str):
        self.file, self.bytes = open_file(path), 0

    def size(self) -> int:
        return self.file.size()

    def read_at(self, n: int, at: int) -> bytes:
        data = self.file.read_at(n, at)
        self.bytes += len(data)
        return data


class Range(InputPartition):
    def __init__(self, lo: int, hi: int, first: int = 0):
        self.lo, self.hi, self.first = lo, hi, first
        super().__init__((lo, hi, first))


class Artifact(DataSourceReader):
    """Bounds (lowest, highest value) of the columns in ``ranged``, gathered from the filters that Spark pushes."""

    ranged: tuple[str, ...] = ()

    def __init__(self, options: dict):
        self.path = options["path"]
        self.rows = int(options.get("rows", PARTITION_ROWS))
        self.bounds: dict[str, tuple[float, float]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column, value = getattr(f, "attribute", ("",))[0], getattr(f, "value", None)
            known = column in self.ranged and len(f.attribute) == 1 and isinstance(value, (int, float)) and not isinstance(value, bool)
            if not known or type(f) not in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual) or value != value:
                yield f
                continue
            low, high = self.bounds.get(column, (-math.inf, math.inf))
            if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                low = max(low, value)
            if isinstance(f, (EqualTo, LessThanOrEqual)):
                high = min(high, value)
            if isinstance(f, GreaterThan):
                low = max(low, math.nextafter(value, math.inf))
            if isinstance(f, LessThan):
                high = min(high, math.nextafter(value, -math.inf))
            self.bounds[column] = (low, high)

    def span(self, column: str, n: int) -> tuple[int, int]:
        """The range of whole numbers below n that a column's bounds leave."""
        low, high = self.bounds.get(column, (-math.inf, math.inf))
        lo, hi = max(0, math.ceil(low)) if low > -math.inf else 0, min(n, math.floor(high) + 1) if high < math.inf else n
        return (lo, hi) if lo < hi else (0, 0)

    def open(self):
        return Counted(self.path)

    def graph(self) -> Slices:
        return Slices(self.path, self.open())


class NodeReader(Artifact):
    ranged = ("node_id", "component_id")

    def partitions(self) -> list[Range]:
        lo, hi = self.span("node_id", self.graph().layout["nodes"])
        return [Range(a, min(a + self.rows, hi)) for a in range(lo, hi, self.rows)] or [Range(0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        file = self.graph()
        low, high = self.bounds.get("component_id", (-math.inf, math.inf))
        for lo in range(part.lo, part.hi, ROWS):
            hi = min(lo + ROWS, part.hi)
            component = file["component", lo, hi]
            chosen = np.flatnonzero((component >= low) & (component <= high))
            if len(chosen):
                columns = [np.arange(lo, hi, dtype=np.int32), file["h3", lo, hi], component, file["node_class", lo, hi].astype(np.int16)]
                yield pa.RecordBatch.from_arrays([pa.array(c[chosen]) for c in columns], names=["node_id", "h3_int", "component_id", "node_class"])


class EdgeReader(Artifact):
    ranged = ("edge_id", "src")

    def partitions(self) -> list[Range]:
        """Ranges of nodes with about ``rows`` edges, and the first edge of each; degrees are streamed."""
        file = self.graph()
        n, (first_edge, last_edge), (lo, hi) = file.layout["nodes"], self.span("edge_id", file.layout["edges"]), self.span("src", file.layout["nodes"])
        found: list[Range] = []
        before, start, start_edge = 0, None, 0
        for at in range(0, n, CHUNK):
            degree = file["degree", at, min(at + CHUNK, n)].astype(np.int64)
            ends = before + np.cumsum(degree)
            begins = ends - degree
            node = np.arange(at, at + len(degree))
            wanted = np.flatnonzero((node >= lo) & (node < hi) & (ends > first_edge) & (begins < last_edge))
            i = 0
            while i < len(wanted):
                if start is None:
                    start, start_edge = int(node[wanted[i]]), int(begins[wanted[i]])
                j = int(np.searchsorted(ends[wanted], start_edge + self.rows))  # the first node that fills the partition
                if j >= len(wanted):
                    last = int(node[wanted[-1]]) + 1
                    break
                found.append(Range(start, int(node[wanted[j]]) + 1, start_edge))
                start, i = None, j + 1
            before = int(ends[-1]) if len(ends) else before
        _need(before == file.layout["edges"], "degrees do not add up to the number of edges")
        if start is not None:
            found.append(Range(start, last, start_edge))
        return found or [Range(0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        first, last = self.span("edge_id", 1 << 62)
        file, edge = self.graph(), part.first
        for lo in range(part.lo, part.hi, ROWS):
            e = file.edges((lo, min(lo + ROWS, part.hi)), edge)
            edge += len(e["edge_id"])
            keep = (e["edge_id"] >= first) & (e["edge_id"] < last)
            kinds = {"edge_id": np.int32, "src": np.int32, "dst": np.int32, "cost": np.float32}
            yield pa.RecordBatch.from_arrays([pa.array(e[c][keep].astype(k)) for c, k in kinds.items()], names=list(kinds))


class PortalFile:
    """An open portal file: bitsets and records by ranges of edges."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        head = file.read_at(min(size, PORTAL_HEADER_BYTES), 0)
        _need(head[:8] == PORTAL_MAGIC, "not a portal file")
        version, self.edges, self.explicit, self.unique, self.has_bytes, explicit_bytes, index_size, record_size = _unpack("<IQQQIIII", head, 8)
        _need(version == 1 and index_size == 4 and record_size == 16, "portal layout is unknown")
        need = -(-self.edges // 8)
        _need(self.has_bytes >= need and explicit_bytes >= need, "portal bitsets are too short")
        self.body = PORTAL_HEADER_BYTES + self.has_bytes + explicit_bytes
        _need(size == self.body + 4 * self.explicit + 16 * self.unique, "portal file has the wrong length")

    def bits(self, own: bool, lo: int, hi: int) -> np.ndarray:
        """Whether the edges of a range have a portal (``own``: an explicit one). ``lo`` is a multiple of 8."""
        at = PORTAL_HEADER_BYTES + (self.has_bytes if own else 0)
        data = self.file.read_at(-(-(hi - lo) // 8), at + lo // 8)
        return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: hi - lo].astype(bool)

    def ranks(self, step: int) -> list[int]:
        """Explicit portals before every ``step``-th edge, and all of them: the bitset is streamed, one number a step is kept."""
        counts = [0]
        for lo in range(0, self.edges, step):
            hi = min(lo + step, self.edges)
            counts.append(counts[-1] + sum(int(self.bits(True, a, min(a + CHUNK, hi)).sum()) for a in range(lo, hi, CHUNK)))
        _need(counts[-1] == self.explicit, "explicit portals do not match their bitset")
        return counts

    def records(self, rank: int, n: int) -> np.ndarray:
        """Ends (n, 4) of n explicit portals from the ``rank``-th on. Records are shared; near ones are read together."""
        index = np.frombuffer(self.file.read_at(4 * n, self.body + 4 * rank), "<u4").astype(np.int64)
        out = np.zeros((n, 4), "<f4")
        if n:
            _need(int(index.max()) < self.unique, "a portal index is out of range")
            order = np.argsort(index, kind="stable")
            ranked = index[order]
            cuts = np.flatnonzero(np.diff(ranked) > 256) + 1
            for part in np.split(np.arange(n), cuts):
                lo, hi = int(ranked[part[0]]), int(ranked[part[-1]]) + 1
                block = np.frombuffer(self.file.read_at(16 * (hi - lo), self.body + 4 * self.explicit + 16 * lo), "<f4").reshape(-1, 4)
                out[order[part]] = block[ranked[part] - lo]
        return out


class PortalReader(Artifact):
    ranged = ("edge_id",)

    def partitions(self) -> list[Range]:
        file = PortalFile(self.open())
        step = -(-self.rows // 8) * 8
        lo, hi = self.span("edge_id", file.edges)
        ranks = file.ranks(step)
        return [Range(i * step, min((i + 1) * step, file.edges), ranks[i]) for i in range(lo // step, -(-hi // step))] or [Range(0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        file, rank = PortalFile(self.open()), part.first
        first, last = self.span("edge_id", file.edges)
        step = ROWS // 8 * 8
        for lo in range(part.lo, part.hi, step):
            hi = min(lo + step, part.hi)
            own = file.bits(True, lo, hi)
            n = int(own.sum())
            if lo < last and hi > first:
                has = file.bits(False, lo, hi)
                edge = np.arange(lo, hi)
                keep = has & (edge >= first) & (edge < last)
                ends = np.zeros((hi - lo, 4))
                wanted = np.flatnonzero(keep & own)
                if len(wanted):  # only the records between the first and the last one wanted
                    nth = np.cumsum(own) - 1
                    a, b = int(nth[wanted[0]]), int(nth[wanted[-1]]) + 1
                    ends[np.flatnonzero(own)[a:b]] = file.records(rank + a, b - a)
                columns = [pa.array(ends[keep, i], mask=~own[keep]) for i in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(edge[keep].astype(np.int32)), pa.array(own[keep]), *columns], names=["edge_id", "is_explicit", "ax", "ay", "bx", "by"])
            rank += n


_HINT = "<i16sBBHfIII4f"


class HintReader(Artifact):
    ranged = ("min_lon", "min_lat", "max_lon", "max_lat")

    def headers(self, file, at: int, n: int) -> Iterator[tuple[int, tuple]]:
        """Place and fixed fields of n hints from a place on."""
        size = struct.calcsize(_HINT)
        for _ in range(n):
            fields = _unpack(_HINT, file.read_at(size, at))
            yield at, fields
            at += size + 8 * (fields[7] + fields[8])

    def partitions(self) -> list[Range]:
        """Every ``rows``-th hint starts a partition: (place, number of hints)."""
        file = self.open()
        head = file.read_at(16, 0)
        _need(head[:8] == HINT_MAGIC, "not a hint file")
        version, count = _unpack("<II", head, 8)
        _need(version == 1, f"hint version {version} is unknown")
        starts, end = [], 16
        for i, (at, fields) in enumerate(self.headers(file, 16, count)):
            if i % self.rows == 0:
                starts.append(at)
            end = at + struct.calcsize(_HINT) + 8 * (fields[7] + fields[8])
        _need(end == file.size(), "hint file has bytes left over")
        return [Range(at, min(self.rows, count - i * self.rows), i * self.rows) for i, at in enumerate(starts)] or [Range(16, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        file, size = self.open(), struct.calcsize(_HINT)
        for at, (cid, code, kind, flags, _, confidence, support, points, spans, *box) in self.headers(file, part.lo, part.hi):
            limits = [self.bounds.get(c, (-math.inf, math.inf)) for c in self.ranged]
            if not all(low <= v <= high for v, (low, high) in zip(box, limits)):
                continue
            body = file.read_at(8 * (points + spans), at + size)
            xy, ids = _unpack(f"<{2 * points}f", body), _unpack(f"<{2 * spans}I", body, 8 * points)
            text = code.split(b"\0", 1)[0].decode("ascii", "replace")
            yield (cid, text, kind, flags, confidence, support, list(zip(xy[::2], xy[1::2])), list(zip(ids[::2], ids[1::2])), *map(float, box))


def _source(short: str, columns: str, reader: type[Artifact]) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return short

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> Artifact:
            return reader(self.options)

    return Source


SOURCES = [
    _source("lanegraph_nodes", "node_id int, h3_int long, component_id int, node_class short", NodeReader),
    _source("lanegraph_edges", "edge_id int, src int, dst int, cost float", EdgeReader),
    _source("lanegraph_portals", "edge_id int, is_explicit boolean, ax double, ay double, bx double, by double", PortalReader),
    _source("lanegraph_hints", schemas.HINTS, HintReader),
]


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let it push filters to them."""
    for source in SOURCES:
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
