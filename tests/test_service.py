"""The service on the diamond, end to end, and the registry."""

import json

import pytest

import __spark_entry__
from lanegraph.plans.service import RouteService, rollup
from lanegraph.operators.ports import unique_locodes, valid_ports
from tests.test_search import EDGE_DDL, EDGES, NODE_DDL, NODES
from lanegraph import schemas


def port(code, cell, access=None, component=None, path=None):
    values = dict.fromkeys(schemas.PORT_FIELDS)
    values |= {"locode": code, "snapped_h3": cell, "snapped_lat": 0.0, "snapped_lon": 0.0, "marine_access_h3": access, "component_id": component, "marine_access_path_coordinates": path}
    return tuple(values.values())


@pytest.fixture(scope="module")
def service(spark):
    rows = [port("TESTA", "85754e67fffffff", path=[[-1.0, 0.0], [0.0, 0.0]]), port("TESTD", "85756b23fffffff"), port("TESTX", "1"), port("TESTB", "85754e67fffffff", "857541affffffff", 7)]
    ports = valid_ports(spark.createDataFrame(rows, schemas.PORTS))
    return RouteService(spark.createDataFrame(NODES, NODE_DDL), spark.createDataFrame(EDGES, EDGE_DDL), ports)


def test_by_locode(spark, service):
    ask = spark.createDataFrame([(1, "testa", "TESTD"), (2, "TESTD", "TESTA"), (3, "NOPE", "TESTA"), (4, "TESTX", "TESTA"), (5, "TESTB", "TESTD")], "request_id long, from_locode string, to_locode string")
    rows = {r["request_id"]: r for r in service.route_by_locode(ask).collect()}
    assert rows[1]["success"] and rows[1]["total_cost"] == 2 and rows[1]["node_count"] == 3 and rows[1]["mode_used"] == "raw"
    line = json.loads(rows[1]["geometry"])["features"][0]["geometry"]["coordinates"]
    assert line == [[-1.0, 0.0], [0.0, 0.0], [1.0, 1.0], [2.0, 0.0]]
    assert rows[2]["error_code"] == "NOPATH" and rows[3]["error_code"] == rows[4]["error_code"] == "PORT_NOT_FOUND"
    assert rows[5]["total_cost"] == 1


def test_by_coordinate(spark, service):
    ask = spark.createDataFrame([(1, 0.1, 0.1, 0.1, 2.1), (2, 60.0, 60.0, 0.0, 0.0)], "request_id long, from_lat double, from_lon double, to_lat double, to_lon double")
    rows = {r["request_id"]: r for r in service.route_by_coordinate(ask).collect()}
    assert rows[1]["success"] and rows[1]["node_count"] == 3 and rows[2]["error_code"] == "SNAP_FAILED"
    assert len(json.loads(rows[1]["geometry"])["features"][0]["geometry"]["coordinates"]) == 5


def test_views(spark, service):
    assert service.health().first()["status"] == "ok"
    assert service.stats().first()["edge_count"] == 4
    assert service.port("testd").count() == 1 and service.list_ports().count() == 4
    assert {(r[0], r[1]) for r in service.warnings().collect()} == {("TESTX", "missing_cell"), ("TESTB", "component_mismatch")}
    assert service.profile().first()["node_count"] == 4
    suite = service.benchmark_suite(2, [("a", "TESTA", "TESTD"), ("b", "TESTD", "TESTA")]).collect()
    counts = {r["name"]: (r["iterations"], r["success_count"], r["failure_count"]) for r in suite}
    assert counts == {"a": (2, 2, 0), "b": (2, 0, 2)}
    with pytest.raises(ValueError):
        unique_locodes(spark.createDataFrame([("a",), ("A",)], "locode string"))


def test_benchmark_beyond_the_broadcast_bound(spark, service, monkeypatch):
    """A network that is not broadcast is searched by joins, with the same results."""
    pairs = spark.createDataFrame([("a", "TESTA", "TESTD"), ("b", "TESTD", "TESTA"), ("c", "NOPE", "TESTA")], "name string, from_locode string, to_locode string")
    want = service.benchmark_runs(pairs, 2).collect()
    large = RouteService(service.nodes, service.edges, service.ports)
    monkeypatch.setattr("lanegraph.operators.search.fits", lambda *_: False)
    got = large.benchmark_runs(pairs, 2).collect()
    assert large.csr is None
    same = ("name", "algorithm", "mode", "iteration", "success", "node_count", "distance_nm", "failure")
    assert sorted(tuple(str(r[c]) for c in same) for r in got) == sorted(tuple(str(r[c]) for c in same) for r in want) and len(got) == 6
    assert all(r["search_ms"] > 0 and r["total_ms"] >= r["search_ms"] for r in got)


def test_rollup_of_failures(spark):
    from lanegraph.plans.service import RUNS

    runs = spark.createDataFrame([("n", "d", "raw", "A", "B", 1, False, None, None, None, None, None, None, None, "why")], RUNS)
    row = rollup(runs).first()
    assert row["avg_search_ms"] == 0 and row["p95_total_ms"] == 0 and row["last_failure"] == "why"


def test_registry():
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and len(names) > 80
