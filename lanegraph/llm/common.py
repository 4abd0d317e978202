"""Shared pieces of the text operators: batches of whole texts, block sums, bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts are handled in groups of about this many bytes, which bounds a worker's memory.
GROUP_BYTES = 3_000_000


def crc_mod(doc_id: str | Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(m)


def groups(batches: Iterable[pa.RecordBatch], text: str, limit: int = GROUP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts as UTF-8 bytes (null: empty), each of about ``limit`` bytes or one longer text."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start), [t if t is not None else b"" for t in col.slice(start, stop - start).to_pylist()]
            start = stop


def map_texts(
    df: DataFrame,
    text: str,
    keep: list[str],
    schema: str,
    fn: Callable[[list[bytes]], list[pa.Array | np.ndarray]],
) -> DataFrame:
    """``keep`` columns followed by what ``fn`` makes of the whole texts; ``schema`` is the DDL of the latter."""
    names = [f"__k{i}" for i in range(len(keep))]
    narrow = df.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).cast("string").alias("__text"))
    kept = ", ".join(f"{n} {narrow.schema[n].dataType.simpleString()}" for n in names)
    out_names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        for rows, texts in groups(batches, "__text"):
            made = [pa.array(x) if isinstance(x, np.ndarray) and x.ndim == 1 else x for x in fn(texts)]
            yield pa.RecordBatch.from_arrays([rows.column(i) for i in range(len(names))] + made, names=names + out_names)

    out = narrow.mapInArrow(run, f"{kept}, {schema}" if kept else schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], *out_names)


def segment_sum(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; a run of length 0 sums to 0."""
    out = np.zeros((len(lengths), *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(lengths)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[full]
        out[full] = np.add.reduceat(values, starts, axis=0)
    return out


# --- sums of large arrays over all partitions ---------------------------------------------

BLOCK_SCHEMA = "salt int, block int, data binary"


def blocks_of(array: np.ndarray, blocks: int, salt: int) -> pa.RecordBatch:
    """A float32 array cut into ``blocks`` rows; all-zero ones are left out."""
    parts = np.array_split(np.ascontiguousarray(array, np.float32).ravel(), blocks)
    rows = [(i, p.tobytes()) for i, p in enumerate(parts) if p.any()]
    return pa.RecordBatch.from_arrays(
        [pa.array([salt] * len(rows), pa.int32()), pa.array([i for i, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())],
        names=["salt", "block", "data"],
    )


def _add_up(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            part = np.frombuffer(data, np.float32)
            if i in sums:
                sums[i] += part
            else:
                sums[i] = part.astype(np.float64)
    rows = sorted(sums.items())
    yield pa.RecordBatch.from_arrays(
        [pa.array([0] * len(rows), pa.int32()), pa.array([i for i, _ in rows], pa.int32()), pa.array([p.astype(np.float32).tobytes() for _, p in rows], pa.binary())],
        names=["salt", "block", "data"],
    )


def sum_blocks(parts: DataFrame, size: int, blocks: int) -> np.ndarray:
    """Total of all tasks' arrays. Two levels: salted sums first, so that no task reads every partition's block.

    Each summing task streams its rows and holds at most its own blocks; what the driver receives
    has ``size`` floats, whatever the input.
    """
    first = parts.repartition("salt", "block").mapInArrow(_add_up, BLOCK_SCHEMA)
    total = first.repartition("block").mapInArrow(_add_up, BLOCK_SCHEMA).collect()
    sizes = [len(p) for p in np.array_split(np.empty(size, np.int8), blocks)]
    out = [np.zeros(n) for n in sizes]
    for row in total:
        out[row["block"]] += np.frombuffer(row["data"], np.float32)
    return np.concatenate(out)
