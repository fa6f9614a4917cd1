"""The chain as a stream: framed samples become states, segments and commits batch by batch.

Each micro-batch leaves folders of its own under the lane's path: ``states``
(committed, with their segments and novelty), ``refused`` (by the gate, or
there before) and ``carried`` (where each stream's fold stands: epoch and
baseline).  The next batch goes on from the newest ``carried`` before it, and a
batch that is run again after a failure overwrites what it left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import taper
from ..operators import graph, novelty, reduce, spectrum
from ..operators.components import written
from ..plans.pipeline import state_id
from ..plans.policies import Policies


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def batches(spark: SparkSession, path: str, table: str) -> list[int]:
    """The batches that have left a whole table, in order."""
    fs, p = _path(spark, f"{path.rstrip('/')}/{table}")
    if not fs.exists(p):
        return []
    found = [s.getPath() for s in fs.listStatus(p)]
    return sorted(int(x.getName()[6:]) for x in found if x.getName().startswith("batch=") and _path(spark, f"{x}/_SUCCESS")[0].exists(_path(spark, f"{x}/_SUCCESS")[1]))


def read(spark: SparkSession, path: str, table: str, before: int | None = None) -> DataFrame | None:
    """The rows of all whole batches (before one), null if there is none."""
    some = [f"{path.rstrip('/')}/{table}/batch={b}" for b in batches(spark, path, table) if before is None or b < before]
    return spark.read.parquet(*some) if some else None


def states_of_frames(frames: DataFrame, policies: Policies) -> DataFrame:
    """States of frames of samples that lie on the grid."""
    name = policies.frame.window_function
    tapered = F.transform("raw", lambda x, i: x * taper(name, i, F.col("size")))
    states, _ = reduce.reduce_spectra(spectrum.spectra(frames.withColumn("windowed", tapered), policies.grid.rate, policies.transform), policies.grid.rate, policies.compression)
    return states


def lane(policies: Policies, path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink for ``sampler.framed`` (``stream_id, w, t0, size, raw``)."""
    root = path.rstrip("/")

    def step(frames: DataFrame, batch_id: int) -> None:
        spark = frames.sparkSession
        earlier = [b for b in batches(spark, root, "carried") if b < batch_id]
        carried = spark.read.parquet(f"{root}/carried/batch={earlier[-1]}") if earlier else None
        states = states_of_frames(frames.select("stream_id", "w", "t0", "size", "raw"), policies)
        segmented = written(novelty.segments(states, policies.anomaly, carried))
        named = segmented.withColumn("state_id", state_id("H1")).withColumns(
            {
                "artifact_class": F.lit("H1"),
                "commit_idx": F.col("w"),
                "compression_policy_id": F.lit(policies.compression.id()),
                "clock_policy_id": F.lit(policies.clock_policy_id),
                "input_refs": F.array(F.concat_ws(":", F.lit("W1"), "stream_id", F.col("w").cast("string"))),
                "uncertainty_time": F.lit(0.0),
            }
        )
        stored = read(spark, root, "states", batch_id)
        added, refused = graph.committed(named, stored)
        added.write.mode("overwrite").parquet(f"{root}/states/batch={batch_id}")
        refused.write.mode("overwrite").parquet(f"{root}/refused/batch={batch_id}")
        novelty.baselines(segmented, policies.anomaly, carried).write.mode("overwrite").parquet(f"{root}/carried/batch={batch_id}")

    return step
