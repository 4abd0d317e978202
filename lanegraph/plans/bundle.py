"""A service from artifact files: one call reads them, holds them against the manifest and times each."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanegraph.plans.service import RouteService
from lanegraph.shared import materialize
from lanegraph.sources import binary, json_files


@dataclass
class Bundle:
    """Paths of the artifacts. Without manifest nothing is compared; a side artifact that is None, or ``smoothing`` off, steps the geometry down."""

    graph: str
    ports: str
    manifest: str | None = None
    portals: str | None = None
    hints: str | None = None
    mask: str | None = None
    smoothing: bool = True


def _facts(spark: SparkSession, path: str) -> dict:
    return {"sha256": binary.artifact_hash(spark, path).first()["sha256"]}


def load_bundle(spark: SparkSession, bundle: Bundle, centers: DataFrame | None = None, implicit: DataFrame | None = None, **options) -> RouteService:
    """The loaded service; ``ArtifactError`` if the manifest and an artifact differ.

    Tables are written once to the shared folder, so requests read them from there. Cell centres and implicit portals follow
    from the cells unless ``centers`` or ``implicit`` are given; ``options`` go to the service. ``RouteService.profile`` tells the times.
    """
    took: dict[str, float] = {}

    def timed(name: str, make):
        start = time.monotonic()
        out = make()
        took[name] = (time.monotonic() - start) * 1000
        return out

    claims = json_files.read_manifest(spark, bundle.manifest) if bundle.manifest else None
    layout = binary.Slices(bundle.graph).layout

    def read_graph() -> tuple[DataFrame, DataFrame]:
        if claims is not None:
            found = {"node_count": layout["nodes"], "edge_count": layout["edges"], "resolution": layout["resolution"]}
            wrong = [k for k, v in found.items() if claims.get(k.replace("_", "")) not in (None, v)]
            if wrong:
                raise binary.ArtifactError("manifest and graph differ in " + ", ".join(wrong))
        sha = claims.get("sha256") if claims is not None else None
        return materialize(binary.read_nodes(spark, bundle.graph, centers, sha), "nodes"), materialize(binary.read_edges(spark, bundle.graph), "edges")

    nodes, edges = timed("graph", read_graph)
    ports = timed("ports", lambda: materialize(json_files.read_ports(spark, bundle.ports), "ports"))
    facts: dict[str, dict] = {}
    portals = hints = mask = None
    if bundle.smoothing and bundle.portals:
        portals = timed("portals", lambda: materialize(binary.read_portals(spark, bundle.portals, layout["edges"], implicit if implicit is not None else binary.implicit_portals(edges, nodes)), "portals"))
        facts["edge_portals"] = {"edge_count": layout["edges"]}  # the reader has refused portals of another graph
    if bundle.smoothing and bundle.hints:
        hints = timed("hints", lambda: materialize(binary.read_hints(spark, bundle.hints, position=True), "hints"))
        facts["corridor_hints"] = {"hint_count": hints.count()}
    if bundle.smoothing and bundle.mask:
        mask = timed("mask", lambda: binary.read_mask(spark, bundle.mask))
        facts["land_mask"] = {"width": mask.width, "height": mask.height}
    if claims is not None:
        for name, path in (("edge_portals", bundle.portals), ("corridor_hints", bundle.hints), ("land_mask", bundle.mask)):
            if name in facts:
                facts[name] |= _facts(spark, path)
        json_files.require_side_artifacts(claims, facts)
    service = RouteService(nodes, edges, ports, mask, portals, hints, **{"resolution": layout["resolution"]} | options)
    service.timings |= took
    return service


def port_warnings(service: RouteService) -> list[str]:
    """What ports and graph disagree on, as text; loading goes on regardless."""
    return [f"{r['locode']}: {r['warning']}" for r in service.warnings().orderBy("locode").select("locode", F.col("warning")).collect()]
