"""A graph file written by many tasks.

Row offsets and the ranks of far targets are prefix sums (``operators.network``), so every task knows where its
rows lie in the file and writes them there. The file grows under a temporary name in the target's folder, which all
executors must reach as a path, and gets its name in one step once every task is done; if a task fails, the
temporary file goes. Tasks may be repeated: they write the same bytes to the same places.
"""

from __future__ import annotations

import os
import struct
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanegraph.operators.network import explicit_rank, out_degrees, row_offsets
from lanegraph.shared import materialize, spread
from lanegraph.sources.binary import ARRAYS, DELTA_OVERFLOW, GRAPH_HEADER_BYTES, GRAPH_MAGIC, _need


def _put(file: int, offset: int, kind: str, index: np.ndarray, values: np.ndarray) -> None:
    """Values to the places ``index`` (rising) of an array; neighbours in one write."""
    values, size = np.ascontiguousarray(values.astype(kind)), np.dtype(kind).itemsize
    cuts = np.flatnonzero(np.diff(index) != 1) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(index)]):
        if hi > lo:
            os.pwrite(file, values[lo:hi].tobytes(), offset + size * int(index[lo]))


def _written(rows: DataFrame, path: str, offsets: dict[str, int], index: str, arrays: dict[str, str], slices: int) -> int:
    """Writes the columns ``arrays`` (array to column) at ``index``; returns the number of rows."""
    columns = list(dict.fromkeys([index, *arrays.values()]))

    def run(batches):
        file, n = os.open(path, os.O_WRONLY), 0
        try:
            for b in batches:
                at = {c: b.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(columns)}
                n += b.num_rows
                for array, c in arrays.items():
                    _put(file, offsets[array], ARRAYS[array], at[index], at[c])
        finally:
            os.close(file)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    dealt = rows.select(*columns).repartitionByRange(slices, index).sortWithinPartitions(index)
    return dealt.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, resolution: int = 5, slices: int | None = None) -> None:
    """A graph file of ``nodes`` (node_id from 0 without gaps, h3_int, component_id, node_class) and ``edges`` (src, dst, cost, edge_id).

    Edges are numbered anew by source, then by their old number. A node may have 255 edges, and both ends must be nodes.
    """
    slices = slices or spread(nodes.sparkSession)
    sizes = nodes.agg(F.count("*").alias("n"), F.count_distinct("node_id").alias("d"), F.min("node_id").alias("lo"), F.max("node_id").alias("hi")).first()
    n = sizes["n"]
    _need(n == sizes["d"] and (n == 0 or (sizes["lo"] == 0 and sizes["hi"] == n - 1)), "node ids are not dense")
    starts = row_offsets(out_degrees(nodes, edges)).select(F.col("node_id").alias("src"), "row_start", (F.col("row_end") - F.col("row_start")).alias("degree"))
    starts = materialize(starts, "row_starts")
    _need((starts.agg(F.max("degree")).first()[0] or 0) <= 255, "a node has more than 255 edges")
    nth = F.row_number().over(Window.partitionBy("src").orderBy("edge_id")) - 1
    far = F.abs(F.col("dst") - F.col("src")) > 32767
    made = edges.select("edge_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "cost").withColumn("nth", nth).join(starts, "src")
    made = made.select((F.col("row_start") + F.col("nth")).alias("edge"), "dst", "cost", F.when(far, DELTA_OVERFLOW).otherwise(F.col("dst") - F.col("src")).alias("delta"), far.cast("int").alias("far"))
    made = materialize(made, "graph_edges")
    totals = made.agg(F.count("*").alias("n"), F.coalesce(F.sum("far"), F.lit(0)).alias("far"), F.min("dst").alias("lo"), F.max("dst").alias("hi")).first()
    _need(totals["n"] == edges.count() and (totals["n"] == 0 or (totals["lo"] >= 0 and totals["hi"] < n)), "an edge leads out of the graph")
    counts = [n, n, n, n, totals["n"], totals["n"], totals["far"], totals["far"]]
    places, at = {}, GRAPH_HEADER_BYTES
    for (array, kind), count in zip(ARRAYS.items(), counts):
        places[array] = at
        at += np.dtype(kind).itemsize * count
    target = Path(path)
    part = str(target.with_name(f".{target.name}-{uuid.uuid4().hex}"))
    try:
        with open(part, "wb") as f:
            f.write(GRAPH_MAGIC + struct.pack("<IIqq8q", 1, resolution, n, totals["n"], *places.values()))
            f.truncate(at)
        degrees = nodes.join(starts.withColumnRenamed("src", "node_id"), "node_id")
        done = _written(degrees, part, places, "node_id", {"h3": "h3_int", "component": "component_id", "node_class": "node_class", "degree": "degree"}, slices)
        done += _written(made, part, places, "edge", {"delta": "delta", "cost": "cost"}, slices)
        if totals["far"]:
            ranked = explicit_rank(made.select(F.col("edge").alias("edge_id"), F.col("far").alias("is_explicit"))).withColumnRenamed("edge_id", "edge")
            done += _written(made.where("far = 1").join(ranked, "edge"), part, places, "explicit_rank", {"position": "edge", "target": "dst"}, slices)
        _need(done == n + totals["n"] + totals["far"], "not all rows were written")
        os.replace(part, path)
    finally:
        Path(part).unlink(missing_ok=True)
