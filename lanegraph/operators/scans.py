"""Scans along ordered rows of a key, in pieces, so that no task holds all rows of a long track or a large group.

Rows are dealt by ranges of (key, order); what a range holds of one key is a piece. Each piece is scanned alone, its
ends and totals make one row, and the carries that pieces of one key hand on to each other are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanegraph.functions.geo import ANTIMERIDIAN_DEGREES
from lanegraph.shared import materialize, spread


def pieces(rows: DataFrame, by: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """The rows with ``__range``, rising with (by, order). Rows that agree in all of these may be split over ranges."""
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(ranges or spread(rows.sparkSession), *by, *order, "__tie")
    return materialize(dealt.withColumn("__range", F.spark_partition_id()), "pieces")


def _jump(lon: Column, before: Column) -> Column:
    return F.coalesce((F.abs(lon - before) > ANTIMERIDIAN_DEGREES).cast("int"), F.lit(0))


def track_runs(points: DataFrame, by: str = "track_id", order: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Rows (track, order, lon, lat) with ``run``: the number of longitude jumps so far in the track."""
    order = order or ["seq"]
    cut = pieces(points, [by], order, ranges)
    key = cut.withColumn("__by", F.struct(by))  # null tracks are a track of their own
    along = Window.partitionBy("__range", "__by").orderBy(*order, "__tie")
    inside = key.withColumn("__jump", _jump(F.col("lon"), F.lag("lon").over(along))).withColumn("__run", F.sum("__jump").over(along)).drop("__jump")
    at = F.struct(*order, "__tie")
    ends = key.groupBy("__range", "__by").agg(F.min_by("lon", at).alias("first"), F.max_by("lon", at).alias("last"))
    totals = inside.groupBy("__range", "__by").agg(F.max("__run").alias("jumps")).join(ends, ["__range", "__by"])
    on = Window.partitionBy("__by").orderBy("__range")  # as many rows as a track has pieces
    carried = totals.withColumn("entry", _jump(F.col("first"), F.lag("last").over(on)))
    carried = carried.withColumn("__carry", F.sum(F.col("entry") + F.col("jumps")).over(on) - F.col("jumps"))
    found = inside.join(carried.select("__range", "__by", "__carry"), ["__range", "__by"])
    return found.select(*points.columns, (F.col("__run") + F.col("__carry")).alias("run"))


def nearest_rank(rows: DataFrame, by: list[str], value: str, share: float, name: str, ranges: int | None = None) -> DataFrame:
    """``by`` and the nearest-rank percentile of a group's values without nulls (null if it has none), read off at its place in the order of all values."""
    kept = rows.select(*by, value)
    cut = pieces(kept.where(F.col(value).isNotNull()), by, [value], ranges).withColumn("__by", F.struct(*by))
    counts = cut.groupBy("__range", "__by").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("__by"))
    through = F.sum("n").over(Window.partitionBy("__by").orderBy("__range"))
    wanted = F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(share) * total - F.lit(1e-9)))
    located = counts.select("__range", "__by", "n", through.alias("through"), wanted.alias("wanted")).where("wanted <= through and wanted > through - n")
    # One piece a group is ordered.
    inside = cut.join(located.select("__range", "__by", (F.col("wanted") - F.col("through") + F.col("n")).alias("place")), ["__range", "__by"])
    nth = F.row_number().over(Window.partitionBy("__range", "__by").orderBy(value, "__tie"))
    found = inside.withColumn("__nth", nth).where("__nth = place").select(F.col("__by").alias("g"), F.col(value).alias(name))
    groups = kept.select(*by).distinct().withColumn("g", F.struct(*by))
    return groups.join(found, groups["g"].eqNullSafe(found["g"]), "left").select(*by, name)
