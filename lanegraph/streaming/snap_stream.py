"""Snapping a stream of positions: stateless, so the batch operator serves as it is, per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lanegraph.operators.snap import nearest, within_radius


def snap_stream(positions: DataFrame, nodes: DataFrame, radius_nm: float) -> DataFrame:
    """All nodes within the radius of each streamed position (query_id, lat, lon): joins with a static table only."""
    return within_radius(positions, nodes, radius_nm)


def snap_batches(positions: DataFrame, nodes: DataFrame, sink: Callable[[DataFrame, int], None], k: int = 5, radius_nm: float = 100.0, checkpoint: str | None = None) -> StreamingQuery:
    """The k nearest nodes of every streamed position; ranking needs a window, so each micro-batch is ranked and handed to ``sink``."""
    writer = positions.writeStream.foreachBatch(lambda batch, number: sink(nearest(batch, nodes, k, radius_nm), number))
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
