"""Shared plumbing of the corpus operators: shared-folder tables and components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where the setting is absent (tests in local mode) a fresh local folder is
    made and set on the session's context.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the tables of the shared folder that these read; nothing may read them any more."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).toUri().getPath()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            if path.toUri().getPath().startswith(root + "/"):
                path.getFileSystem(conf).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of jobs that are over removed from the disks.

    Spark removes them when the driver happens to collect the garbage of their plans;
    between steps that each shuffle the corpus this asks for it.  The second round gets
    what the cleaning after the first one has set free.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partitions, by which its owner sizes jobs to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has an edge.

    Min-label hooking with pointer jumping.  Each round is one join of edges with
    labels, one min per vertex (combined before its shuffle, so a hub costs no more
    than its edges) and one label look-up; labels go to the shared folder each round.
    Rows with a null end are ignored; no edges give an empty table.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    e = materialize(e.unionAll(e.select(F.col("y"), F.col("x"))).distinct(), "edges")
    labels = materialize(e.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.col("id")).alias("component")), "labels")
    while True:
        near = e.join(labels, e.y == labels.id).groupBy(F.col("x").alias("v")).agg(F.min("component").alias("m"))
        hooked = labels.join(near, labels.id == near.v, "left").select("id", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        up = labels.select(F.col("id").alias("p"), F.col("component").alias("pc"))
        new = hooked.join(up, hooked.c == up.p, "left").select("id", "old", F.least("c", "pc").alias("component"))
        new = materialize(new, "labels")
        if new.where("component < old").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")
