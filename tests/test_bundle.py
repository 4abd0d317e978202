"""A bundle of files end to end, and GeoJSON files as a sink."""

import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanegraph.plans.bundle import Bundle, load_bundle, port_warnings
from lanegraph.sources import binary as b
from lanegraph.sources import geojson_sink as g
from tests.test_sources import DIAMOND, H3
from tests.test_tiles import grid, mask_file


@pytest.fixture()
def files(tmp_path):
    hints = b.encode_hints([(1, "TESTA", 2, 1, 0.9, 3, [(0.0, 0.0), (1.0, 1.0)], [(0, 1)], 0.0, 0.0, 1.0, 1.0)])
    ports = [{"locode": c, "snapped_h3": f"{h:x}", "snapped_lat": 0.0, "snapped_lon": 0.0, "component_id": 0} for c, h in (("TESTA", H3[0]), ("TESTD", H3[3]), ("TESTX", 1))]
    data = {
        "graph": DIAMOND,
        "ports": json.dumps(ports).encode(),
        "portals": b.encode_portals(np.ones(4), np.ones(4), np.zeros(4), np.array([[0.5, 0.4, 0.4, 0.5]])),
        "hints": hints,
        "mask": mask_file(grid(0.0), 3),
    }
    sha = {k: hashlib.sha256(v).hexdigest() for k, v in data.items()}
    claims = {
        "sha256": sha["graph"].upper(), "nodeCount": 4, "edgeCount": 4, "resolution": 5, "EdgePortals": {"sha256": sha["portals"], "edgeCount": 4},
        "aisCorridorHints": {"sha256": sha["hints"], "hintCount": 1}, "landMask": {"sha256": sha["mask"], "width": 50, "height": 40},
    }
    for name, text in data.items():
        (tmp_path / name).write_bytes(text)
    paths = {name: str(tmp_path / name) for name in data}

    def bundle(changes=None, **parts):
        (tmp_path / "manifest").write_text(json.dumps(claims | (changes or {})))
        return Bundle(manifest=str(tmp_path / "manifest"), **(paths | parts))

    return bundle


def centers(spark):
    return spark.createDataFrame([(h, lat, lon) for h, lat, lon in zip(H3, (0.0, 0.1, 0.05, 0.1), (0.0, 0.1, 0.2, 0.3))], "h3_int long, lat double, lon double")


def test_a_bundle_is_loaded_checked_and_timed(spark, files):
    service = load_bundle(spark, files(), centers(spark))
    asked = spark.createDataFrame([(1, "testa", "TESTD"), (2, "TESTX", "TESTA")], "request_id long, from_locode string, to_locode string")
    rows = {r["request_id"]: r for r in service.route_by_locode(asked).collect()}
    assert rows[1]["success"] and rows[1]["total_cost"] == 2 and rows[1]["mode_used"] == "funnel" and rows[2]["error_code"] == "PORT_NOT_FOUND"
    profile = service.profile().first()
    assert all(profile[f"{c}_ms"] > 0 for c in ("graph", "ports", "portals", "hints", "mask", "network", "geometry"))
    assert profile["startup_ms"] >= profile["graph_ms"] and profile["heap_bytes"] > 0 and profile["working_set_bytes"] > 0 and profile["smoothing"]
    assert port_warnings(service) == ["TESTX: missing_cell"]


def test_a_bundle_without_side_artifacts_steps_down(spark, files):
    asked = spark.createDataFrame([(1, "TESTA", "TESTD")], "request_id long, from_locode string, to_locode string")
    for bundle, mode in ((files(smoothing=False), "raw"), (files(portals=None), "shortcut"), (files(mask=None, hints=None), "raw")):
        assert load_bundle(spark, bundle, centers(spark)).route_by_locode(asked).first()["mode_used"] == mode


def test_a_bundle_that_differs_from_its_manifest_is_refused(spark, files):
    cases = [
        ({"sha256": "00"}, "SHA-256"), ({"nodeCount": 5}, "node_count"), ({"resolution": 6}, "resolution"), ({"edgePortals": {"sha256": "00"}, "EdgePortals": None}, "edge_portals.sha256"),
        ({"aisCorridorHints": {"hintCount": 2}}, "hint_count"), ({"landMask": {"width": 51}}, "width"),
    ]
    for changes, why in cases:
        with pytest.raises(b.ArtifactError, match=why):
            load_bundle(spark, files(changes), centers(spark))


def feature(i):
    return json.dumps({"type": "Feature", "properties": {"n": i, "t": 'a"]}'}, "geometry": {"type": "Point", "coordinates": [i, 0.5]}}, separators=(",", ":"))


def test_geojson_files(spark, tmp_path):
    g.register(spark)
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(feature(i),) for i in range(50)] + [(None,)], "feature string").repartition(4)
    rows.write.format("lanegraph_geojson").mode("append").save(path)
    parts = g.listed(path)
    assert sum(p["features"] for p in parts) == 50 and len(parts) == 4
    for p in parts:
        with open(f"{path}/{p['name']}") as f:
            whole = json.load(f)
        assert whole["type"] == "FeatureCollection" and len(whole["features"]) == p["features"]
    number = F.get_json_object("feature", "$.properties.n").cast("int")
    assert sorted(r[0] for r in g.read_features(spark, path).select(number).collect()) == list(range(50))
    assert {r[0] for r in g.read_features(spark, path).collect()} == {feature(i) for i in range(50)}
    rows.limit(3).write.format("lanegraph_geojson").mode("append").save(path)
    assert g.read_features(spark, path).count() == 53
    rows.where(number < 7).write.format("lanegraph_geojson").mode("overwrite").save(path)
    assert g.read_features(spark, path).count() == 7
    assert {n for n in os.listdir(path) if n.endswith(".geojson")} == {p["name"] for p in g.listed(path)}
    broken = rows.select(F.when(number == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("feature")).alias("feature"))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("lanegraph_geojson").mode("append").save(path)
    assert g.read_features(spark, path).count() == 7


def test_empty_geojson(spark, tmp_path):
    g.register(spark)
    path = str(tmp_path / "none")
    spark.createDataFrame([], "feature string").write.format("lanegraph_geojson").mode("append").save(path)
    assert g.listed(path) == [] and g.read_features(spark, path).count() == 0 and os.listdir(path) == [g.LIST]


def test_features_of_collections(spark):
    rows = spark.createDataFrame([('{"type":"FeatureCollection","features":[' + feature(1) + "," + feature(2) + "]}",), ('{"type":"FeatureCollection","features":[]}',), (None,)], "geometry string")
    assert [json.loads(r[0]) for r in g.features_of(rows, "geometry").collect()] == [json.loads(feature(i)) for i in (1, 2)]
