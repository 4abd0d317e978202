"""A graph written by many tasks is the file that one process makes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanegraph.sources import binary as b
from lanegraph.sources.graph_writer import write_graph


def tables(spark, n=40_000, m=3_000):
    r = np.random.default_rng(8)
    src = np.concatenate([r.integers(0, n, m), np.full(200, 5), np.full(90, n - 1)])
    dst, cost = r.integers(0, n, len(src)), r.random(len(src)).astype(np.float32)
    near = r.random(len(src)) < 0.5
    dst[near] = np.clip(src[near] + r.integers(-20, 20, int(near.sum())), 0, n - 1)
    order = np.argsort(src, kind="stable")
    h3, component, kind = np.arange(n) + 7, r.integers(-1, 9, n), r.integers(0, 3, n)
    nodes = spark.createDataFrame(list(zip(range(n), h3.tolist(), component.tolist(), kind.tolist())), "node_id int, h3_int long, component_id int, node_class short")
    edges = spark.createDataFrame([(i, int(a), int(c), float(x)) for i, (a, c, x) in enumerate(zip(src, dst, cost))], "edge_id int, src int, dst int, cost float")
    return nodes.repartition(5), edges.repartition(5), b.encode_graph(h3, component, kind, src[order], dst[order], cost[order])


@pytest.mark.parametrize("slices", [1, 7])
def test_the_file_is_the_same_in_any_number_of_slices(spark, tmp_path, slices):
    nodes, edges, want = tables(spark)
    path = tmp_path / "graph.bin"
    path.write_bytes(b"old")
    write_graph(nodes, edges, str(path), slices=slices)
    assert path.read_bytes() == want
    assert [p.name for p in tmp_path.iterdir()] == ["graph.bin"]


def test_written_graphs_are_read_again(spark, tmp_path):
    nodes, edges, _ = tables(spark, 50, 120)
    path = str(tmp_path / "graph.bin")
    write_graph(nodes, edges.where("src <> 5 and src <> 49"), path)
    rows = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    assert rows(b.read_edges(spark, path), "src", "dst", "cost") == rows(edges.where("src <> 5 and src <> 49"), "src", "dst", "cost")
    assert rows(b.read_nodes(spark, path), "node_id", "h3_int", "component_id", "node_class") == rows(nodes, "node_id", "h3_int", "component_id", "node_class")
    write_graph(nodes.limit(0), edges.limit(0), path)
    assert b.read_nodes(spark, path).count() == b.read_edges(spark, path).count() == 0


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    nodes, edges, _ = tables(spark, 50, 120)
    path = str(tmp_path / "graph.bin")
    broken = edges.withColumn("cost", F.when(F.col("edge_id") == 100, F.raise_error(F.lit("lost")).cast("float")).otherwise(F.col("cost")))
    bad_class = nodes.withColumn("node_class", F.when(F.col("node_id") == 40, F.raise_error(F.lit("lost")).cast("short")).otherwise(F.col("node_class")))
    for n, e in ((nodes, broken), (bad_class, edges)):
        with pytest.raises(Exception, match="lost"):
            write_graph(n, e, path, slices=3)
    many = edges.unionByName(spark.range(300).selectExpr("cast(id + 100000 as int) as edge_id", "3 as src", "4 as dst", "float(1) as cost"))
    out = edges.unionByName(spark.createDataFrame([(9, 1, 50, 1.0)], edges.schema))
    gone = edges.unionByName(spark.createDataFrame([(9, 77, 1, 1.0)], edges.schema))
    for n, e in ((nodes, many), (nodes, out), (nodes, gone), (nodes.where("node_id <> 3"), edges)):
        with pytest.raises(b.ArtifactError):
            write_graph(n, e, path)
    assert list(tmp_path.iterdir()) == []
