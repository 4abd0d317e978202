"""What the derived network and the searches beyond the broadcast bound leave on disk and shuffle."""

import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from lanegraph.operators import hints, search
from lanegraph.plans import catalog
from lanegraph.plans.derived import LEGS, Derived
from lanegraph.shared import shared_dir

DATA = "/root/testdata/sf0.001"
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def tables(spark):
    top = shared_dir(spark).removeprefix("file://")
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_edges_leave_one_table_which_joins_read_in_place(spark):
    spark.conf.unset(FREED)
    before = tables(spark)
    d = Derived(spark, DATA)
    assert spark.conf.get(FREED) == "true"  # shuffle files go with the query that made them
    edges = d.edges
    left = tables(spark) - before
    assert len(left) == 1 and "edges" in left.pop()
    met = edges.join(spark.range(40).selectExpr("cast(id as int) src").hint("merge"), "src")
    assert exchanges(met) == 1 and "Bucketed: true" in met._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset(FREED)


def test_legs_are_those_of_the_sql(spark, tmp_path):
    """Also of items that are equal but for their quantity, or for what the order of LEGS ends with."""
    items = spark.read.parquet(f"{DATA}/lineitem.parquet")
    again = items.where("l_orderkey % 3 = 0").withColumns({"l_quantity": F.col("l_quantity") + F.col("l_orderkey") % 2, "l_extendedprice": F.col("l_extendedprice") - 1})
    items.unionByName(again).write.parquet(f"{tmp_path}/lineitem.parquet")
    d = Derived(spark, str(tmp_path))
    legs, want = d.legs, d.sql(LEGS)
    assert legs.dtypes == want.dtypes and legs.count() > items.count()
    assert legs.exceptAll(want).count() == 0 == want.exceptAll(legs).count()
    assert "l_extendedprice" not in legs._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset(FREED)


def test_expanding_deals_each_side_once(spark):
    rows = spark.range(4000).selectExpr("cast(id as int) edge_id", "cast(id % 90 as int) src", "cast(id * 7 % 83 as int) dst", "cast(id % 11 as float) cost")  # with repeats
    front = rows.select(F.col("src").alias("source"), F.col("dst").alias("at"), F.col("cost").alias("so_far"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = search.expand_costs(front, rows, 16)
        assert exchanges(found) <= 5  # both sides to their blocks, and the edges and the blocks' ends to their join
        a, b = rows.toDF("e1", "source", "at", "c1"), rows.toDF("e2", "at", "node_id", "c2")
        want = a.join(b, "at").groupBy("source", "node_id").agg(F.min(F.col("c1").cast("double") + F.col("c2").cast("double")).alias("distance"))
        assert found.exceptAll(want).count() == 0 == want.exceptAll(found).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_few_paths_need_no_gates_of_all_edges(spark):
    """Shapes are the same as with the gates of all edges, which are not made."""
    d = Derived(spark, "/root/testdata/sf0.01")
    paths = d.paths.where("path_id < 12").select("path_id", "path_nodes", F.lit("funnel").alias("mode"), F.lit("n0003").alias("from_locode"), F.lit("n0007").alias("to_locode"))
    some, every = catalog.service(d), catalog.service(d)
    assert every.gates.count() == d.edges.count()
    got = some.draw(paths).drop("shape_ms")
    assert "gates" not in some.__dict__
    want = every.draw(paths).drop("shape_ms").collect()
    assert len(want) == paths.count() > 5 and sorted(got.collect()) == sorted(want)
    spark.conf.unset(FREED)


def test_best_approach_without_ordering_all_hints(spark):
    nan = float("nan")
    rows = [(i, f"n{i % 5}", 1 + (i % 7 == 0), [0.5, nan, None, 0.9, -0.0, 0.0, 0.9][(i * 3) % 7] if i % 5 != 1 else None, [i]) for i in range(80)]
    made = spark.createDataFrame(rows, "corridor_id long, locode string, kind int, confidence double, spans array<int>")
    best = hints.port_approaches(made)
    assert "Window" not in best._jdf.queryExecution().executedPlan().toString()
    nth = F.row_number().over(Window.partitionBy("locode").orderBy(F.col("confidence").desc(), "corridor_id"))
    want = made.where("kind = 1").withColumn("n", nth).where("n = 1").select("corridor_id", "spans", F.upper("locode").alias("code"))
    assert sorted(best.select("corridor_id", "spans", "code").collect()) == sorted(want.collect())
