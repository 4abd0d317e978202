"""Artifacts round-trip, and malformed ones are refused."""

import hashlib
import json
import struct
import zlib

import numpy as np
import pytest

from lanegraph.operators.raster import Raster
from lanegraph.sources import binary as b
from lanegraph.sources import json_files as j

H3 = [601042424243945471, 601041550218100735, 601042110711332863, 601044398855159807]
DIAMOND = b.encode_graph(H3, [0] * 4, [1] * 4, [0, 0, 1, 2], [1, 2, 3, 3], [1, 2, 1, 1])


def put(tmp_path, data, name="file.bin"):
    path = tmp_path / name
    path.write_bytes(data)
    return str(path)


def test_graph(spark, tmp_path):
    path = put(tmp_path, DIAMOND)
    sha = hashlib.sha256(DIAMOND).hexdigest().upper()
    edges = b.read_edges(spark, path, sha).orderBy("edge_id").collect()
    assert [(e["src"], e["dst"], e["cost"], e["flags"]) for e in edges] == [(0, 1, 1.0, None), (0, 2, 2.0, None), (1, 3, 1.0, None), (2, 3, 1.0, None)]
    centers = spark.createDataFrame([(H3[0], 0.0, 0.0)], "h3_int long, lat double, lon double")
    nodes = b.read_nodes(spark, path, centers).orderBy("node_id").collect()
    assert [n["h3_int"] for n in nodes] == H3 and nodes[0]["lat"] == 0 and nodes[1]["lat"] is None
    assert b.artifact_hash(spark, path).first()["sha256"] == sha.lower()
    with pytest.raises(b.ArtifactError, match="SHA-256"):
        b.read_edges(spark, path, "00")
    with pytest.raises(Exception):
        b.read_edges(spark, str(tmp_path / "none")).collect()


@pytest.mark.parametrize("bad", [b"abc", b"\xff" + DIAMOND[1:], DIAMOND[:-1], DIAMOND + b"1234", DIAMOND[:8] + struct.pack("<I", 2) + DIAMOND[12:]])
def test_bad_graphs(spark, tmp_path, bad):
    with pytest.raises(b.ArtifactError):
        b.read_edges(spark, put(tmp_path, bad))


def test_slices_of_a_graph(spark, tmp_path):
    """Any number of slices gives the same rows, deltas out of range and nodes without edges included."""
    r = np.random.default_rng(1)
    n = 90_000
    src = np.sort(np.concatenate([r.integers(0, n, 3000), np.full(200, 5), np.full(200, n - 1)]))
    dst = r.integers(0, n, len(src))
    cost = r.random(len(src)).astype(np.float32)
    path = put(tmp_path, b.encode_graph(np.arange(n) + 7, r.integers(0, 9, n), r.integers(0, 3, n), src, dst, cost))
    rows = lambda df, c: sorted(tuple(x) for x in df.select(*c).collect())
    want = sorted(zip(range(len(src)), src.tolist(), dst.tolist(), cost.astype(float).tolist()))
    nodes = rows(b.read_nodes(spark, path, slices=1), ["node_id", "h3_int", "component_id", "node_class"])
    assert [x[:2] for x in nodes] == [(i, i + 7) for i in range(n)]
    for slices in (1, 3, 13):
        edges = b.read_edges(spark, path, slices=slices)
        assert edges.rdd.getNumPartitions() == slices and rows(edges, ["edge_id", "src", "dst", "cost"]) == want
        assert rows(b.read_nodes(spark, path, slices=slices), ["node_id", "h3_int", "component_id", "node_class"]) == nodes
    assert b.read_edges(spark, "file://" + path, slices=2).count() == len(src)
    whole = open(path, "rb").read()
    spare = b.graph_layout(whole[:96], len(whole))
    at = spare["offset"]["position"]
    second = struct.unpack("<I", whole[at + 4 : at + 8])[0]
    for i, value in ((0, second), (5, 1)):  # an edge twice; entries out of order
        bad = bytearray(whole)
        bad[at + 4 * i : at + 4 * i + 4] = struct.pack("<I", value)
        with pytest.raises(Exception, match="overflow"):
            b.read_edges(spark, put(tmp_path, bytes(bad), "bad.bin"), slices=4).collect()
    bad = bytearray(whole)
    bad[spare["offset"]["degree"]] += 1
    with pytest.raises(b.ArtifactError, match="degrees"):
        b.read_edges(spark, put(tmp_path, bytes(bad), "bad.bin"))
    assert b.read_edges(spark, put(tmp_path, b.encode_graph([], [], [], [], [], []), "none.bin")).count() == 0


def test_side_artifacts_against_manifest():
    manifest = {"edgeportals": {"sha256": "AB", "edgecount": 4}, "aiscorridorhints": {"hintcount": 2}, "landmask": {"width": 8, "height": 5}}
    good = {"edge_portals": {"sha256": "ab", "edge_count": 4}, "corridor_hints": {"sha256": "x", "hint_count": 2}, "land_mask": {"width": 8, "height": 5}}
    j.require_side_artifacts(manifest, good)
    j.require_side_artifacts({}, good)
    bad = {"edge_portals": {"sha256": "cd", "edge_count": 4}, "corridor_hints": {"hint_count": 3}, "land_mask": {"width": 8, "height": 6}}
    assert j.side_artifact_errors(manifest, bad) == ["edge_portals.sha256", "corridor_hints.hint_count", "land_mask.height"]
    with pytest.raises(b.ArtifactError, match="hint_count"):
        j.require_side_artifacts(manifest, bad)


def test_portals(spark, tmp_path):
    data = b.encode_portals([1, 1, 1], [0, 1, 0], [0], [[10, 20, 30, 40]])
    path = put(tmp_path, data)
    implicit = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 4.0), (2, 1.0, 2.0, 3.0, 4.0)], "edge_id int, ax double, ay double, bx double, by double")
    rows = {r["edge_id"]: r for r in b.read_portals(spark, path, 3, implicit).collect()}
    assert rows[1]["is_explicit"] and rows[1]["by"] == 40 and rows[0]["ax"] == rows[2]["ax"] == 1
    with pytest.raises(Exception, match="implicit"):
        b.read_portals(spark, path, 3).collect()
    for bad, count in ((b"badmagic" * 8, None), (data, 4), (data + b"x", 3), (data[:-1], 3)):
        with pytest.raises(b.ArtifactError):
            b.decode_portals(bad, count)


def mask_file(version, tile=False):
    head = b.MASK_MAGIC + struct.pack("<III5dI", version, 2, 2, 1000.0, 0.0, 0.0, 2000.0, 2000.0, 1)
    bits = bytes([0b10000000])
    if version == 1:
        return head + struct.pack("<Q", 4) + bits
    if version == 2:
        at = len(head) + 16 + 8 + 16
        return head + struct.pack("<IIII", 2, 2, 1, 1) + struct.pack("<Q", 4) + struct.pack("<QII", at, 1, 1) + bits
    packed = zlib.compress(bits)
    return head + struct.pack("<IIII", 2, 2, 1, 1) + struct.pack("<I", 1) + struct.pack("<Q", 4) + struct.pack("<QIII", 113, len(packed), 1, 1) + b"\1" + packed


@pytest.mark.parametrize("version", [1, 2, 3])
def test_masks(spark, tmp_path, version):
    path = put(tmp_path, mask_file(version))
    r = b.read_mask(spark, path)
    assert r.land(0, 0) and not r.land(0, 1) and not r.land(1, 1)
    meta, tiles = b.read_mask_tables(spark, path)
    assert [tuple(x) for x in b.land_cells(tiles, meta.first().asDict()).collect()] == [(0, 0)]
    with pytest.raises(b.ArtifactError):
        b.decode_mask(mask_file(version)[:60])


def test_empty_tile_is_water_and_sizes_checked():
    assert not Raster(2, 2, 1.0, 0, 0, 2, 2, None, (2, 2), {0: b""}, 1).land(0, 0)
    with pytest.raises(ValueError):
        Raster(0, 2, 1.0, 0, 0, 2, 2, b"")
    with pytest.raises(ValueError):
        Raster(8, 2, 1.0, 0, 0, 2, 2, b"1")


def test_hints(spark, tmp_path):
    rows = [(1, "AUMEL", 1, 1, 0.9, 12, [(1.0, 2.0), (3.0, 4.0)], [(10, 11)], 1.0, 2.0, 3.0, 4.0), (9, "", 2, 1, 0.8, 20, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], [(3, 4), (4, 5)], 0.0, 0.0, 2.0, 2.0)]
    data = b.encode_hints(rows)
    from lanegraph.operators.hints import port_approaches, route_windows

    made = b.read_hints(spark, put(tmp_path, data))
    assert [(r["code"], [tuple(s) for s in r["spans"]]) for r in port_approaches(made).collect()] == [("AUMEL", [(10, 11)])]
    assert [r["corridor_id"] for r in route_windows(made).collect()] == [9]
    for bad in (data + b"x", data[:-1], b"nomagic!" + data[8:]):
        with pytest.raises(b.ArtifactError):
            b.decode_hints(bad)


def test_ports(spark, tmp_path):
    fields = ["locode", "snapped_h3", "snapped_lat", "snapped_lon", "marine_access_path_coordinates", "component_id", "port_lat"]
    row = ["TESTA", "64", 1.5, 2.5, [[1.0, 2.0], [3.0, 4.0]], 0]
    compact = {"schema": "ocean_ports_runtime", "schemaVersion": 2, "fields": fields, "ports": [row, ["  ", "1", 1, 1], ["TESTB", "65", None, 1.0]]}
    got = j.read_ports(spark, put(tmp_path, json.dumps(compact).encode(), "p.json")).collect()
    assert len(got) == 1 and got[0]["name"] == "TESTA" and got[0]["component_id"] == 0 and got[0]["port_lat"] is None
    assert got[0]["marine_access_path_coordinates"] == [[1.0, 2.0], [3.0, 4.0]] and got[0]["snap_distance_nm"] == 0
    legacy = json.dumps([{"locode": "TESTA", "snapped_h3": "64", "snapped_lat": 1.5, "snapped_lon": 2.5, "name": "A \"b\""}])
    assert j.parse_ports(spark, legacy).first()["name"] == 'A "b"'
    for bad in ("5", '{"schema": "x"}', '{"schema": "ocean_ports_runtime", "schemaVersion": 1}', '{"schema": "ocean_ports_runtime", "schemaVersion": 2, "fields": [], "ports": [5]}'):
        with pytest.raises(b.ArtifactError):
            j.parse_ports(spark, bad)


def test_manifest(spark, tmp_path):
    path = put(tmp_path, json.dumps({"NodeCount": 4, "Graph": {"Sha256": "AB"}}).encode(), "m.json")
    assert j.read_manifest(spark, path) == {"nodecount": 4, "graph": {"sha256": "AB"}}
    ddl = "node_count int, edge_count int, resolution int, sha256 string"
    claim, fact = spark.createDataFrame([(4, 4, 5, "AB")], ddl), spark.createDataFrame([(4, 5, 6, "ab")], ddl)
    errors = j.manifest_errors(claim, fact)
    assert errors.first()["errors"] == ["edge_count", "resolution"]
    with pytest.raises(b.ArtifactError, match="edge_count, resolution"):
        j.require_no_errors(errors)
