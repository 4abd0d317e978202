"""Artifacts as data sources: the rows of the whole-file readers, by ranges, and fewer bytes with a filter."""

import numpy as np
import pytest

from lanegraph.sources import binary as b
from lanegraph.sources import formats


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    r = np.random.default_rng(3)
    n = 30_000
    src = np.sort(np.concatenate([r.integers(0, n, 90_000), np.full(200, 5), np.full(100, n - 1)]))
    dst, cost = r.integers(0, n, len(src)), r.random(len(src)).astype(np.float32)
    place = tmp_path_factory.mktemp("files")
    component = np.where(np.arange(n) < 3000, 7, 2)
    has, own = r.random(len(src)) < 0.8, r.random(len(src)) < 0.3
    own &= has
    payload = r.random((900, 4)).astype(np.float32)
    hints = [(i, "AUMEL" if i % 2 else "", 1 + i % 2, i % 4, 0.5, i, [(float(i), 1.0), (2.0, 3.0)], [(i, i + 1)] * (1 + i % 3), float(i), 0.0, float(i) + 1, 2.0) for i in range(50)]
    made = {
        "graph": b.encode_graph(np.arange(n) + 7, component, r.integers(0, 3, n), src, dst, cost),
        "portals": b.encode_portals(has, own, r.integers(0, 900, int(own.sum())), payload),
        "hints": b.encode_hints(hints),
    }
    for name, data in made.items():
        (place / name).write_bytes(data)
    return {name: str(place / name) for name in made}


def rows(df, columns=None):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def read(spark, kind, path, **options):
    formats.register(spark)
    return spark.read.format(f"lanegraph_{kind}").options(**options).load(path)


@pytest.mark.parametrize("size", [5_000, 10**6])
def test_rows_equal_the_whole_file_readers(spark, files, size):
    nodes, edges = b.read_nodes(spark, files["graph"]), b.read_edges(spark, files["graph"])
    got = read(spark, "nodes", files["graph"], rows=size)
    assert rows(got) == rows(nodes, got.columns)
    got = read(spark, "edges", files["graph"], rows=size)
    assert rows(got) == rows(edges, got.columns)
    assert got.rdd.getNumPartitions() == (1 if size > 10**5 else pytest.approx(19, abs=1))
    given = spark.range(90_300).selectExpr("cast(id as int) as edge_id", "double('NaN') as ax", "double('NaN') as ay", "double('NaN') as bx", "double('NaN') as by")
    want = b.read_portals(spark, files["portals"], None, given).replace(float("nan"), None)
    got = read(spark, "portals", files["portals"], rows=size)
    assert rows(got) == rows(want, got.columns)
    got = read(spark, "hints", files["hints"], rows=7)
    assert rows(got) == rows(b.read_hints(spark, files["hints"])) and got.rdd.getNumPartitions() == 8


@pytest.mark.parametrize(
    "kind,file,test",
    [
        ("nodes", "graph", "node_id >= 2000 and node_id < 2900 and h3_int % 2 = 0"),
        ("nodes", "graph", "component_id = 7"),
        ("nodes", "graph", "node_id > 29998"),
        ("nodes", "graph", "node_id < 0"),
        ("edges", "graph", "src = 5"),
        ("edges", "graph", "src between 100 and 130 and cost < 0.5"),
        ("edges", "graph", "edge_id > 17 and edge_id <= 60"),
        ("edges", "graph", "edge_id = 90299"),
        ("edges", "graph", "src = 5 and edge_id < 3"),
        ("portals", "portals", "edge_id >= 40001 and edge_id < 40100"),
        ("portals", "portals", "edge_id = 3 or edge_id = 5"),
        ("hints", "hints", "min_lon >= 10 and max_lon <= 13.5"),
        ("hints", "hints", "min_lon > 48 and kind = 1"),
    ],
)
def test_filters_leave_the_right_rows(spark, files, kind, file, test):
    every = read(spark, kind, files[file], rows=2_000)
    columns = every.columns
    want = rows(spark.createDataFrame(every.collect(), every.schema).where(test))
    assert rows(every.where(test), columns) == want


def taken(reader, filters):
    """Bytes that partitions and tasks read, and what is left for Spark to filter."""
    opened = []
    reader.open = lambda: opened.append(formats.Counted(reader.path)) or opened[-1]
    left = list(reader.pushFilters(filters))
    for part in reader.partitions():
        list(reader.read(part))
    return sum(f.bytes for f in opened), left


def test_a_filter_reads_fewer_bytes(files):
    ge, lt, eq = formats.GreaterThanOrEqual, formats.LessThan, formats.EqualTo
    cases = [
        (formats.NodeReader, "graph", [ge(("node_id",), 100), lt(("node_id",), 600)], 0.05),
        (formats.NodeReader, "graph", [eq(("component_id",), 3)], 0.35),
        (formats.EdgeReader, "graph", [eq(("src",), 9)], 0.1),
        (formats.PortalReader, "portals", [ge(("edge_id",), 1000), lt(("edge_id",), 1100)], 0.2),
        (formats.HintReader, "hints", [eq(("min_lon",), 3.0)], 0.85),
    ]
    for kind, file, filters, share in cases:
        whole, _ = taken(kind({"path": files[file], "rows": 2_000}), [])
        some, left = taken(kind({"path": files[file], "rows": 2_000}), filters)
        assert not left and some < share * whole, (kind, some, whole)
    other = formats.EqualTo(("node_class",), 1)
    assert taken(formats.NodeReader({"path": files["graph"]}), [other])[1] == [other]


def test_ranks_by_steps_equal_counts(files):
    file = formats.PortalFile(formats.Counted(files["portals"]))
    own = file.bits(True, 0, file.edges)
    for step in (8, 1024, 10**6):
        assert file.ranks(step) == [int(own[:at].sum()) for at in [*range(0, file.edges, step), file.edges]]


def test_bad_files_are_refused(files, tmp_path):
    for name, reader in (("graph", formats.EdgeReader), ("portals", formats.PortalReader), ("hints", formats.HintReader)):
        data = open(files[name], "rb").read()
        for bad in (b"x" * 100, data[:-1], data + b"1"):
            path = tmp_path / "bad"
            path.write_bytes(bad)
            with pytest.raises(b.ArtifactError):
                reader({"path": str(path)}).partitions()
