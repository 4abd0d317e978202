"""Where intermediate tables go: a folder that the driver and every executor can reach.

Loops and multi-pass operators cut their lineage by writing a Parquet table below the folder
named by ``spark.checkpoint.dir`` and reading it back, so a lost executor costs at most the
tasks it was running. Only in local mode, where driver and executors share a disk, a folder is made
if that setting is missing; on a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder below ``spark.checkpoint.dir``; removed when Python exits."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="lanegraph-")
        root = f"{base.rstrip('/')}/lanegraph-{app}-{uuid.uuid4().hex[:8]}"
        _ROOTS[app] = root
        atexit.register(_remove, spark, root)
    return _ROOTS[app]


def _remove(spark: SparkSession, root: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        remove(spark, root)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lives in."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def remove_table(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``, once nothing will read it again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


def materialize(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as read back from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """From now on the session drops a query's shuffle files once it has ended; else they stay until the driver happens to collect its garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", True)


def materialize_bucketed(df: DataFrame, tag: str, key: str) -> DataFrame:
    """The same in ``spread`` buckets by ``key``, so that joins on it read the table in place instead of shuffling it each time. ``df`` is dealt by the key into as many tasks before."""
    spark = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}"
    n = spread(spark)
    df.write.bucketBy(n, key).option("path", f"{shared_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    back = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # of the catalog only: the files stay, and ``back`` knows them and their buckets
    return back


def spread(spark: SparkSession) -> int:
    """A number of tasks for small rows with much work each, which adaptive execution would put into one task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
