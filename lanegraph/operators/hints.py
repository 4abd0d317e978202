"""Corridor hints as tables: selection by code, windows on paths by the hashes of runs of edges, choice without overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanegraph.operators.geometry import BIDIRECTIONAL, PORT_APPROACH, ROUTE_WINDOW, hint_lines
from lanegraph.operators.network import places
from lanegraph.operators.raster import Raster
from lanegraph.shared import materialize

#: Where the paths have this many times fewer legs than there are hints, hints are first met with the legs.
FEW = 4


def is_bidirectional(flags: Column) -> Column:
    return flags.cast("int").bitwiseAND(F.lit(BIDIRECTIONAL)) != 0


def place_of(hints: DataFrame) -> str:
    """What decides between equal hints: their ``position`` in the file if it is known, else their number."""
    return "position" if "position" in hints.columns else "corridor_id"


def port_approaches(hints: DataFrame) -> DataFrame:
    """Per port code (upper case) the most confident approach; of equals the one of the lowest ``place_of``."""
    rows = hints.where((F.col("kind") == PORT_APPROACH) & F.col("locode").isNotNull() & (F.trim("locode") != "")).withColumn("code", F.upper("locode"))
    known = ~F.coalesce(F.isnan("confidence"), F.lit(False))  # falling order has NaN first and nulls last
    order = F.struct(F.col("confidence").isNull().alias("none"), known.alias("known"), (-F.col("confidence")).alias("falling"), F.col(place_of(hints)).alias("place"))
    return rows.groupBy("code").agg(F.min_by(F.struct(*rows.columns), order).alias("best")).select("best.*")


def usable_windows(hints: DataFrame) -> DataFrame:
    return hints.where((F.col("kind") == ROUTE_WINDOW) & (F.size("spans") > 0) & (F.size("coords") >= 2))


def route_windows(hints: DataFrame) -> DataFrame:
    """Usable generic windows with ``place`` (from 1) by falling confidence, then edges, then ``place_of``."""
    return places(usable_windows(hints), [(F.col("confidence"), True), (F.size("spans"), True), (F.col(place_of(hints)), False)], "place")


def _steps(hints: DataFrame) -> DataFrame:
    """hint, corridor_id, n, flags, backwards, pos, src, dst: each hint's edges forwards, and backwards. Equal rows are one hint."""
    rows = hints.select("corridor_id", "flags", "spans").distinct().withColumn("hint", F.xxhash64("corridor_id", "flags", "spans"))
    base = rows.select("hint", "corridor_id", F.size("spans").alias("n"), "flags", F.posexplode("spans").alias("step", "s"))
    ahead = base.select("hint", "corridor_id", "n", "flags", F.lit(False).alias("backwards"), F.col("step").alias("pos"), F.col("s.src").alias("src"), F.col("s.dst").alias("dst"))
    back = base.select("hint", "corridor_id", "n", "flags", F.lit(True).alias("backwards"), (F.col("n") - 1 - F.col("step")).alias("pos"), F.col("s.dst").alias("src"), F.col("s.src").alias("dst"))
    return ahead.unionByName(back)


def run_hashes(steps: DataFrame, by: list[str], lengths: list[int]) -> DataFrame:
    """The steps (by, pos, src, dst) with ``run_n`` for each length n: a hash of the n edges from here on, null where they do not follow each other.

    By doubling: n edges are the first and the last ceil(n / 2) of them, so a length costs one column, and all lengths take
    as many passes along a path as the longest can be halved.
    """
    depth = {1: 0}

    def need(n: int) -> int:
        if n not in depth:
            depth[n] = need((n + 1) // 2) + 1
        return depth[n]

    for n in lengths:
        need(n)
    along = Window.partitionBy(*by).orderBy("pos")
    found = steps.withColumn("run_1", F.xxhash64("src", "dst"))
    for level in range(1, max(depth.values()) + 1):
        made = {}
        for n in (n for n, k in depth.items() if k == level):
            half = (n + 1) // 2
            rest = F.lead(f"run_{half}", n - half).over(along)
            whole = F.col(f"run_{half}").isNotNull() & rest.isNotNull() & (F.lead("pos", n - half).over(along) == F.col("pos") + (n - half))
            made[f"run_{n}"] = F.when(whole, F.xxhash64(f"run_{half}", rest))
        found = found.withColumns(made)
    return found


def _at_lengths(steps: DataFrame, by: list[str], lengths: list[int], keep: list[str]) -> DataFrame:
    """(keep, pos, n, run) of every run of one of the lengths."""
    hashed = run_hashes(steps, by, lengths)
    runs = F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"run_{n}").alias("run")) for n in lengths])
    return hashed.select(*keep, "pos", F.explode(F.filter(runs, lambda r: r["run"].isNotNull())).alias("r")).select(*keep, "pos", "r.n", "r.run")


def run_candidates(legs: DataFrame, steps: DataFrame) -> DataFrame:
    """path_id, hint, corridor_id, flags, backwards, start, n where the hash of a hint's whole run meets that of a run on a path."""
    lengths = sorted(r["n"] for r in steps.select("n").distinct().collect())  # no more than the longest hint has edges
    if not lengths:
        return steps.select(F.lit(None).cast("long").alias("path_id"), "hint", "corridor_id", "flags", "backwards", F.col("pos").alias("start"), "n").limit(0)
    own = ["hint", "corridor_id", "flags", "backwards"]
    wanted = _at_lengths(steps.withColumnRenamed("n", "size"), ["hint", "backwards"], lengths, [*own, "size"]).where("pos = 0 and n = size")
    on_paths = _at_lengths(legs.select("path_id", "pos", "src", "dst"), ["path_id"], lengths, ["path_id"])
    return on_paths.withColumnRenamed("pos", "start").join(wanted.select(*own, "n", "run"), ["n", "run"]).select("path_id", *own, "start", "n")


def _matches(legs: DataFrame, hints: DataFrame) -> DataFrame:
    """path_id, corridor_id, backwards, start, n, flags where all of a hint's edges follow each other on a path (path_id, pos, src, dst).

    Candidates meet by the hash of their whole run, never edge by edge, and are then compared step by step.
    """
    steps = _steps(hints)
    found = materialize(run_candidates(legs, steps), "run_candidates")
    each = found.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("step"))
    each = each.join(steps.select("hint", "backwards", F.col("pos").alias("step"), "src", "dst"), ["hint", "backwards", "step"])
    met = each.withColumn("pos", F.col("start") + F.col("step")).join(legs.select("path_id", "pos", "src", "dst"), ["path_id", "pos", "src", "dst"])
    return met.groupBy("path_id", "hint", "corridor_id", "backwards", "start", "n", "flags").agg(F.count("*").alias("hits")).where("hits = n")


def generic_windows(legs: DataFrame, hints: DataFrame) -> DataFrame:
    """path_id, corridor_id, start, end, backwards: every offset; backwards only if the hint allows it and does not match forwards there."""
    found = _matches(legs, usable_windows(hints)).where(~F.col("backwards") | is_bidirectional(F.col("flags")))
    once = found.groupBy("path_id", "corridor_id", "start", "n").agg(F.min("backwards").alias("backwards"))
    return once.select("path_id", "corridor_id", "start", (F.col("start") + F.col("n")).alias("end"), "backwards")


def on_legs(hints: DataFrame, legs: DataFrame) -> DataFrame:
    """The hints whose first edge, or whose last one backwards, is a leg; no others can lie on a path."""
    first, last = F.get("spans", F.lit(0)), F.element_at("spans", -1)
    ends = hints.select("corridor_id", F.explode(F.array(F.struct(first["src"].alias("src"), first["dst"].alias("dst")), F.struct(last["dst"].alias("src"), last["src"].alias("dst")))).alias("e"))
    met = ends.select("corridor_id", "e.src", "e.dst").join(legs.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
    return hints.join(met.select("corridor_id").distinct(), "corridor_id", "left_semi")


def port_windows(legs: DataFrame, ends: DataFrame, hints: DataFrame) -> DataFrame:
    """path_id, corridor_id, start, end, side for ``ends`` (path_id, n_nodes, from_locode, to_locode): the first port's hint forwards at 0, the last one's backwards at the tail, whatever its flag."""
    best = port_approaches(hints)
    found = _matches(legs, best).join(best.select("corridor_id", "code"), "corridor_id").join(ends, "path_id")
    first = found.where(~F.col("backwards") & (F.col("start") == 0) & (F.upper("from_locode") == F.col("code"))).withColumn("side", F.lit("start"))
    last = found.where(F.col("backwards") & (F.col("start") + F.col("n") == F.col("n_nodes") - 1) & (F.upper("to_locode") == F.col("code"))).withColumn("side", F.lit("end"))
    return first.unionByName(last).select("path_id", "corridor_id", "start", (F.col("start") + F.col("n")).alias("end"), "side")


def select_windows(candidates: DataFrame) -> DataFrame:
    """path_id, chosen array<struct<start,end,corridor_id>> in route order from candidates (path_id, kind, corridor_id, start, end, confidence).

    A fold over each path's windows, best first: one is taken if it overlaps none taken before.
    """
    key = F.struct(
        F.when(F.col("kind") == PORT_APPROACH, -2).otherwise(-1).alias("k"), (F.col("start") - F.col("end")).alias("e"), (-F.col("confidence")).alias("c"),
        F.col("start").alias("start"), F.col("end").alias("end"), F.col("corridor_id").alias("corridor_id"),
    )
    ordered = candidates.groupBy("path_id").agg(F.sort_array(F.collect_list(key)).alias("all"))
    slim = F.transform("all", lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["corridor_id"].alias("corridor_id")))
    kind = "array<struct<start:int,end:int,corridor_id:long>>"
    fold = F.aggregate(slim.cast(kind), F.array().cast(kind), lambda taken, w: F.when(F.exists(taken, lambda t: (w["end"] > t["start"]) & (w["start"] < t["end"])), taken).otherwise(F.concat(taken, F.array(w))))
    return ordered.select("path_id", F.sort_array(fold).alias("chosen"))


def path_windows(legs: DataFrame, ends: DataFrame, hints: DataFrame, raster: Raster) -> DataFrame:
    """path_id, kind, n, confidence, start, end, line of the hints that may shape each path: ``kind`` 2 for port approaches, 1 for others.

    Each hint that lies on some path is drawn once; one without a safe line shapes nothing. Of hints of one kind on the same
    legs of a path only the most confident can be chosen (of equals the one of the lowest ``place_of``), so the others are left out.
    """
    named = ["corridor_id", "locode", "kind", "flags", "confidence", "spans", "coords", *([] if place_of(hints) == "corridor_id" else [place_of(hints)])]
    hints = materialize(hints.select(*named), "hints")  # read for selection, runs, lines and confidence
    usable = usable_windows(hints)
    if FEW * legs.count() < usable.count():
        usable = materialize(on_legs(usable, legs), "usable")
    generic = generic_windows(legs, usable).select("path_id", "corridor_id", "start", "end", "backwards", F.lit(1).alias("kind"))
    port = port_windows(legs, ends, hints).select("path_id", "corridor_id", "start", "end", (F.col("side") == "end").alias("backwards"), F.lit(2).alias("kind"))
    found = materialize(generic.unionByName(port), "windows")
    lines = hint_lines(hints.join(found.select("corridor_id").distinct(), "corridor_id", "left_semi"), raster)
    drawn = found.join(lines, ["corridor_id", "backwards"]).join(hints.select("corridor_id", F.col(place_of(hints)).alias("place"), F.col("confidence").cast("double").alias("confidence")), "corridor_id")
    best = drawn.groupBy("path_id", "kind", "start", "end").agg(F.min_by(F.struct("confidence", "line"), F.struct(-F.col("confidence"), F.col("place"))).alias("b"))
    return best.select("path_id", "kind", (F.col("end") - F.col("start")).alias("n"), "b.confidence", "start", "end", "b.line")
