"""Connected components of an edge table by rounds of minimum labels with short cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder in the one that driver and executors share; it goes when the application ends.

    A local session that names no shared folder gets one; a cluster must name one.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        path = context.getCheckpointDir()
    own = f"{path.rstrip('/')}/tidemark-{context.applicationId}"
    if own not in _LEAVING:
        fs, at = _fs(spark, own)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _LEAVING.add(own)
    return own


#: Folders that are marked to go with their application.
_LEAVING: set[str] = set()


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def written(df: DataFrame) -> DataFrame:
    """The rows from a table in the shared folder: their lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing reads any more."""
    if path := getattr(df, "_written_at", None):
        fs, at = _fs(df.sparkSession, path)
        fs.delete(at, True)


def components(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """``by, node, label``: each node with the smallest node it reaches; edges ``(by, a, b)`` stay inside a partition key.

    A round takes the least label of a node's neighbours and then that label's
    own, so the number of rounds is about the logarithm of the longest path.
    """
    both = written(edges.select(by, "a", "b").unionByName(edges.select(by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(nodes.select(by, "node", F.col("node").alias("label")))
    while True:
        near = both.join(labels.select(by, F.col("node").alias("b"), "label"), [by, "b"]).groupBy(by, F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, [by, "node"], "left").select(by, "node", F.least("label", "near").alias("label"))
        up = lower.select(by, F.col("node").alias("label"), F.col("label").alias("up"))
        new = written(lower.join(up, [by, "label"], "left").select(by, "node", F.least("label", "up").alias("label")))
        if new.join(labels.withColumnRenamed("label", "old"), [by, "node"]).where("label <> old").isEmpty():
            discard(both)
            discard(labels)
            return new
        discard(labels)
        labels = new
