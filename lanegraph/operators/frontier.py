"""Goal-directed search by joins, for networks that are too large to be broadcast.

All requests advance together. A unit of search is a source (Dijkstra: one tree for all targets of a source, no wider
than the farthest of them) or a pair of nodes (bidirectional A*: a tree from either side). A round
releases the cheapest open nodes of each unit and side, all within ``step`` of the smallest key, and joins them
with the edges; what improves a label is written as a delta, and deltas are merged every ``MERGE`` rounds.

Dijkstra's key is the distance g, and a node is open only while g is no more than the distance of the unit's
farthest target. A two-sided key is g plus the landmark bound on the way that is left, and a node v of one side
is dropped for good once g(v) + max(bound(v), least open g of the other side) reaches the best meeting found:
a cheaper path through v would have been met already. A pair ends when either side has no node left.

Joins by unit are salted, since one request may own most of the rows; no window spans a unit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanegraph.operators.network import adjacency, landmarks
from lanegraph.shared import materialize, remove_table

MERGE = 8
SALTS = 16
BUCKETS = 1024
#: Up to so many units, Spark may broadcast a table of them; their files are small for what they hold.
FEW_UNITS = 10_000
LABEL = "struct<g:double,edge:int,before:int>"


def _by_unit(rows: DataFrame, small: DataFrame, many: bool = False) -> DataFrame:
    """Inner join on ``unit`` with a table of one row a unit; a unit's rows are spread over SALTS keys.

    ``many``: the table is shuffled, however small its files look, since a broadcast goes through the driver.
    """
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = salted.hint("merge") if many else salted
    return rows.withColumn("__salt", F.pmod("node", F.lit(SALTS)).cast("int")).join(salted, ["unit", "__salt"]).drop("__salt")


def _large(rows: DataFrame, many: bool) -> DataFrame:
    return rows.hint("merge") if many else rows


def landmark_columns(nodes: DataFrame, table: DataFrame) -> DataFrame:
    """node, marks: the distances from and to every landmark (null where there is no path), by a node's row."""
    ids = [r["node_id"] for r in landmarks(nodes).orderBy("place").collect()]  # four at most
    at = lambda i, c: F.max(F.when(F.col("landmark") == i, F.col(c)))
    lists = [F.array(*[at(i, c) for i in ids]).cast("array<double>") if ids else F.array().cast("array<double>") for c in ("from_landmark", "to_landmark")]
    return table.groupBy(F.col("node_id").alias("node")).agg(F.struct(lists[0].alias("out"), lists[1].alias("into")).alias("marks"))


def _bound(a: Column, b: Column) -> Column:
    """Landmark bound on the cost from the node of marks ``a`` to that of ``b``."""
    gap = lambda x, y: F.array_max(F.zip_with(x, y, lambda p, q: p - q))
    return F.greatest(F.lit(0.0), F.coalesce(gap(b["out"], a["out"]), F.lit(0.0)), F.coalesce(gap(a["into"], b["into"]), F.lit(0.0))) * (1 - 1e-12)


def _bounded(rows: DataFrame, ends: DataFrame, marks: DataFrame | None, many: bool) -> DataFrame:
    """Open rows (unit, node, side, g) with p, the bound on what is left to the other end of a pair; 0 for trees."""
    if marks is None:
        return rows.withColumn("p", F.lit(0.0))
    known = _by_unit(rows.join(_large(marks, many), "node", "left"), ends, many)
    p = F.when(F.col("s_marks").isNull(), 0.0).when(F.col("side") == 0, _bound(F.col("marks"), F.col("t_marks"))).otherwise(_bound(F.col("s_marks"), F.col("marks")))
    return known.select("unit", "node", "side", "g", F.coalesce(p, F.lit(0.0)).alias("p"))


def _current(versions: list[DataFrame]) -> DataFrame:
    """The newest labels (unit, node, f, b)."""
    if len(versions) == 1:
        return versions[0].select("unit", "node", "f", "b")
    rows = reduce(DataFrame.unionByName, versions)
    newest = rows.groupBy("unit", "node").agg(F.max_by(F.struct("f", "b"), "round").alias("x"))
    return newest.select("unit", "node", "x.f", "x.b")


def _steps(released: DataFrame, ahead: DataFrame, back: DataFrame | None) -> DataFrame:
    """Best step into each node over one edge from the released nodes, by side: unit, node, cf, cb (g, edge, before, cost).

    Steps that reach the limit of their unit are left out before they become rows: no better path goes there."""
    near = released.select("unit", F.col("node").alias("at"), "side", "g", "best", "tree")
    met = near.where("side = 0").join(ahead, "at")
    if back is not None:
        met = met.unionByName(near.where("side = 1").join(back, "at"))
    useful = F.filter("steps", lambda x: F.when(F.col("tree"), F.col("g") + x["cost"] <= F.col("best")).otherwise(F.col("g") + x["cost"] < F.col("best")))
    rows = met.select("unit", "at", "side", "g", F.explode(useful).alias("x")).select("unit", "side", F.col("x.node").alias("node"), F.struct((F.col("g") + F.col("x.cost")).alias("g"), F.col("x.edge").alias("edge"), F.col("at").alias("before"), F.col("x.cost").alias("cost")).alias("step"))
    return rows.groupBy("unit", "node").agg(F.min(F.when(F.col("side") == 0, F.col("step"))).alias("cf"), F.min(F.when(F.col("side") == 1, F.col("step"))).alias("cb"))


def _improved(steps: DataFrame, labels: DataFrame, many: bool) -> DataFrame:
    """Labels that a step changes: unit, node, f, b, and which sides are cheaper than before. Of equal ones the smaller edge stays, unless the step is free (it may close a circle)."""
    both = steps.join(_large(labels, many), ["unit", "node"], "left")
    chosen = {}
    for old, new, side in (("f", "cf", "up_f"), ("b", "cb", "up_b")):
        cheaper = F.col(new).isNotNull() & F.coalesce(F.col(f"{new}.g") < F.col(f"{old}.g"), F.lit(True))
        tie = F.coalesce((F.col(f"{new}.g") == F.col(f"{old}.g")) & (F.col(f"{new}.edge") < F.col(f"{old}.edge")) & (F.col(f"{new}.cost") > 0), F.lit(False))
        chosen[side] = cheaper
        chosen["tie_" + old] = tie
        chosen["new_" + old] = F.when(cheaper | tie, F.struct(F.col(f"{new}.g").alias("g"), F.col(f"{new}.edge").alias("edge"), F.col(f"{new}.before").alias("before"))).otherwise(F.col(old))
    rows = both.select("unit", "node", *[c.alias(n) for n, c in chosen.items()]).where("up_f or up_b or tie_f or tie_b")
    return rows.select("unit", "node", F.col("new_f").alias("f"), F.col("new_b").alias("b"), "up_f", "up_b")


def grow(units: DataFrame, targets: DataFrame, edges: DataFrame, marks: DataFrame | None, step: float) -> tuple[DataFrame, DataFrame]:
    """Labels (unit, node, f, b) and what each unit came to: best, released_f, released_b.

    ``units``: unit, s, t (null for a tree). ``targets``: unit, node of trees. ``marks`` (for pairs): see ``landmark_columns``.
    """
    inf = F.lit(float("inf"))
    none = F.lit(None).cast(LABEL)
    root = F.struct(F.lit(0.0).alias("g"), F.lit(-1).alias("edge"), F.lit(-1).alias("before")).cast(LABEL)
    units = materialize(units.select("unit", "s", "t", inf.alias("best"), F.lit(0).cast("long").alias("released_f"), F.lit(0).cast("long").alias("released_b")), "units")
    targets = materialize(targets.select("unit", "node", inf.alias("g")), "targets")
    asked = units.count()
    many = asked > FEW_UNITS
    if not asked:
        return materialize(units.select("unit", F.col("s").alias("node"), none.alias("f"), none.alias("b")), "labels"), units
    ahead, back = adjacency(edges), None
    ends = None
    if marks is not None:
        back = adjacency(edges, True)
        marks = _large(marks, many)
        with_s = units.join(marks.withColumnsRenamed({"node": "s", "marks": "s_marks"}), "s", "left")
        with_t = with_s.join(marks.withColumnsRenamed({"node": "t", "marks": "t_marks"}), "t", "left")
        ends = materialize(with_t.select("unit", F.when(F.col("t").isNotNull(), F.col("s_marks")).alias("s_marks"), F.col("t_marks")), "ends")
    start = units.select("unit", F.col("s").alias("node"), root.alias("f"), none.alias("b")).unionByName(units.where("t is not null").select("unit", F.col("t").alias("node"), none.alias("f"), root.alias("b")))
    versions = [materialize(start.withColumn("round", F.lit(0)), "labels")]
    waiting = _bounded(start.select("unit", "node", F.when(F.col("f").isNull(), 1).otherwise(0).alias("side"), F.lit(0.0).alias("g")), ends, marks, many)
    drop: list[DataFrame] = []
    for turn in range(1, 1 << 30):
        # What may still be on a better path.
        least = waiting.groupBy("unit").agg(F.min(F.when(F.col("side") == 0, F.col("g"))).alias("g0"), F.min(F.when(F.col("side") == 1, F.col("g"))).alias("g1"))
        known = _by_unit(waiting, _large(units, many).join(_large(least, many), "unit"), many)
        other = F.coalesce(F.when(F.col("side") == 0, F.col("g1")).otherwise(F.col("g0")), inf)
        alive = F.when(F.col("t").isNull(), F.col("g") <= F.col("best")).otherwise(F.col("g") + F.greatest("p", other) < F.col("best"))
        # Two-sided units need a node on either side, also before the first meeting.
        alive = alive & (F.col("t").isNull() | (F.col("g0").isNotNull() & F.col("g1").isNotNull()))
        waiting = materialize(known.where(alive).select("unit", "node", "side", "g", "p", F.col("t").isNull().alias("tree"), "best"), "waiting")
        for table in drop:
            remove_table(table)
        key = F.col("g") + F.col("p")
        keys = waiting.groupBy("unit").agg(F.min(F.when(F.col("side") == 0, key)).alias("k0"), F.min(F.when(F.col("side") == 1, key)).alias("k1"), F.first("tree").alias("tree"))
        keys = keys.where("tree or (k0 is not null and k1 is not null)").drop("tree")
        if not keys.limit(1).count():
            break
        dealt = _by_unit(waiting, keys, many)
        now = key <= F.when(F.col("side") == 0, F.col("k0")).otherwise(F.col("k1")) + F.lit(step)
        dealt = dealt.select("unit", "node", "side", "g", "p", "best", "tree", now.alias("now"))
        released, kept = dealt.where("now"), dealt.where("not now")
        delta = materialize(_improved(_steps(released, ahead, back), _current(versions), many).withColumn("round", F.lit(turn)), "labels")
        versions.append(delta.select("unit", "node", "f", "b", "round"))
        # The best meeting of a pair, or the farthest target of a tree.
        reached = delta.select("unit", "node", F.col("f.g").alias("d"))
        before_targets, targets = targets, materialize(targets.join(_large(reached, many), ["unit", "node"], "left").select("unit", "node", F.coalesce("d", "g").alias("g")), "targets")
        met = delta.groupBy("unit").agg(F.min(F.col("f.g") + F.col("b.g")).alias("met"))
        far = targets.groupBy("unit").agg(F.max("g").alias("far"))
        done = released.groupBy("unit").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
        found = units.join(_large(met, many), "unit", "left").join(_large(far, many), "unit", "left").join(_large(done, many), "unit", "left")
        best = F.when(F.col("t").isNull(), F.coalesce("far", inf)).otherwise(F.least("best", F.coalesce("met", inf)))
        add = lambda c, n: (F.col(c) + F.coalesce(F.col(n), F.lit(0))).alias(c)
        before_units, units = units, materialize(found.select("unit", "s", "t", best.alias("best"), add("released_f", "n0"), add("released_b", "n1")), "units")
        side = lambda c, up, i: delta.where(up).select("unit", "node", F.lit(i).alias("side"), F.col(f"{c}.g").alias("g"))
        fresh = _bounded(side("f", "up_f", 0).unionByName(side("b", "up_b", 1)), ends, marks, many)
        drop = [waiting, before_targets, before_units]
        merged = kept.select("unit", "node", "side", "g", "p").unionByName(fresh).groupBy("unit", "node", "side").agg(F.min(F.struct("g", "p")).alias("x"))
        waiting = merged.select("unit", "node", "side", "x.g", "x.p")
        if turn % MERGE == 0:
            old, versions = versions, [materialize(_current(versions).withColumn("round", F.lit(turn)), "labels")]
            waiting = materialize(waiting, "waiting")
            for table in [*old, *drop]:
                remove_table(table)
            drop = [waiting]
    for table in (ahead, back):
        if table is not None:
            remove_table(table)
    return materialize(_current(versions), "labels"), units


def ranks(ends: DataFrame, labels: DataFrame) -> DataFrame:
    """(unit, node, rank): the place of each end in its unit's tree by distance, then node. Distances are cut into BUCKETS a unit, so no task orders a whole tree."""
    rows = labels.where("f is not null").select("unit", "node", F.col("f.g").alias("g"))
    far = rows.groupBy("unit").agg(F.max("g").alias("far"))
    cut = _by_unit(rows, far).withColumn("bucket", F.when(F.col("far") > 0, F.floor(F.col("g") / F.col("far") * BUCKETS)).otherwise(0).cast("int")).drop("far")
    counts = cut.groupBy("unit", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("unit").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    asked = cut.join(ends.select("unit", "node").distinct(), ["unit", "node"], "left_semi").select("unit", "bucket").distinct()
    inside = cut.join(asked, ["unit", "bucket"], "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("unit", "bucket").orderBy("g", "node")))
    placed = inside.join(counts.withColumn("before", before), ["unit", "bucket"])
    return placed.join(ends.select("unit", "node").distinct(), ["unit", "node"], "left_semi").select("unit", "node", (F.col("before") + F.col("nth")).cast("int").alias("rank"))
