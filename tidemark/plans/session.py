"""Runs one after the other: each is reduced to a signature row, registered, compared with the others, bundled."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import digest, novelty, runs, trajectory
from ..operators.components import written
from ..sources import files
from . import pipeline
from .policies import Policies

KINDS = ("new_frequency", "vanished_frequency", "drift", "energy_shift")


def reports(run: pipeline.Run, policies: Policies) -> DataFrame:
    """Each state against its segment's baseline."""
    states = run.states
    base = states.select(F.col("stream_id").alias("__s"), F.col("w").alias("__w"), F.struct(*states.columns).alias("base"))
    pairs = states.where("base_w is not null").select("stream_id", "w", "base_w", F.struct(*states.columns).alias("current"))
    return novelty.compare(pairs.join(base, (F.col("stream_id") == F.col("__s")) & (F.col("base_w") == F.col("__w"))).drop("__s", "__w", "base_w"), policies.anomaly)


def signature(run: pipeline.Run, policies: Policies, label: str, index: int, query_present: bool = False) -> DataFrame:
    """One row: what a run looks like (means) and what it holds (counts)."""
    tag = lambda df: df.withColumn("run_idx", F.lit(index))
    found = run.committed
    parts = [
        tag(found).groupBy("run_idx").agg(
            F.count(F.lit(1)).alias("state_count"), F.count_if(F.col("artifact_class") == "H1").alias("h1_count"), F.count_if(F.col("artifact_class") == "M1").alias("m1_count"), F.count_distinct("segment_id").alias("segment_count"),
            F.avg(runs.dominant_frequency(F.col("kept_bins"))).alias("dominant_frequency_hz_mean"), F.avg(F.col("t_end") - F.col("t_start")).alias("state_duration_sec_mean"),
        ),
        tag(reports(run, policies).select("novelty_gate_triggered", F.transform("detected_events", lambda e: e["type"]).alias("kinds"))).groupBy("run_idx").agg(
            F.count(F.lit(1)).alias("anomaly_count"), F.count_if("novelty_gate_triggered").alias("novelty_gate_count"), *[F.sum(F.size(F.filter("kinds", same))).alias(f"{k}_event_count") for k in KINDS for same in [_is(k)]]
        ),
        tag(run.neighborhoods).groupBy("run_idx").agg(F.count(F.lit(1)).alias("basin_count"), F.avg("radius").alias("basin_radius_mean"), F.avg("member_count").alias("basin_member_count_mean")),
        tag(trajectory.report(run.trajectory)).groupBy("run_idx").agg(F.sum("total_transitions").alias("total_transitions"), F.sum("total_re_entries").alias("total_re_entries"), F.sum("total_frames_considered").alias("trajectory_frames")),
        tag(trajectory.recurrence(run.trajectory)).groupBy("run_idx").agg(F.avg("re_entry_count").alias("recurrence_mean")),
        runs.mean_profile(tag(found.where("artifact_class = 'H1'")), "run_idx", "profile", "h1_band_profile_mean"),
        runs.mean_profile(tag(found.where("artifact_class = 'M1'")), "run_idx", "profile", "m1_band_profile_mean"),
        runs.mean_profile(tag(run.neighborhoods), "run_idx", "centroid", "basin_band_profile_mean"),
    ]
    one = reduce(lambda a, b: a.join(b, "run_idx", "left"), parts)
    density = F.coalesce("total_transitions", F.lit(0)) / F.greatest(F.lit(1), F.coalesce("trajectory_frames", F.lit(0)) - 1)
    marks = digest.markers(F.col("novelty_gate_count"), F.col("total_transitions"), F.col("basin_count"), F.col("total_re_entries"), F.col("segment_count"))
    return one.withColumns({"run_label": F.lit(label), "query_present": F.lit(int(query_present)), "transition_density": density} | marks)


def _is(kind: str) -> Callable:
    return lambda x: x == kind


class Session:
    """A registry of runs; a label is taken once, and the newest ``most`` runs stay."""

    def __init__(self, spark: SparkSession, policies: Policies, most: int = 25) -> None:
        self.spark, self.policies, self.most = spark, policies, most
        self.signatures: DataFrame | None = None
        self.latest: pipeline.Run | None = None
        self.count = 0

    def labels(self) -> list[str]:
        return [] if self.signatures is None else [r["run_label"] for r in self.signatures.orderBy("run_idx").select("run_label").collect()]

    def ingest(self, samples: DataFrame, label: str) -> pipeline.Run:
        """Runs the whole chain on samples and registers the run."""
        if label in self.labels():
            raise ValueError(f"run label {label!r} is taken")
        run = pipeline.run(samples, self.policies, written)
        row = written(signature(run, self.policies, label, self.count))
        self.signatures = row if self.signatures is None else written(runs.register(self.signatures, row, self.most))
        self.latest, self.count = run, self.count + 1
        return run

    def compare(self) -> tuple[DataFrame, DataFrame]:
        """(pairs of runs, reproducibility of all)."""
        if self.signatures is None:
            raise ValueError("no run yet")
        pairs = runs.pairs(self.signatures)
        return pairs, runs.reproducibility(pairs)

    def cycles(self) -> DataFrame:
        """The runs as cycles of a digest, each with its changes against the one before."""
        rows = self.signatures.select(F.lit("session").alias("session"), F.col("run_idx").alias("cycle_index"), "run_label", "state_count", "convergence", "recurrence")
        return rows.join(digest.deltas(rows, "session"), ["session", "cycle_index"])

    def bundle(self) -> DataFrame:
        """The latest run as one JSON document a stream."""
        run = self.latest
        return files.bundle(run.summary, receipts=run.receipts, transitions=run.transitions, skipped=run.skipped, merge_failures=run.merge_failures)

    def clear(self) -> None:
        self.signatures, self.latest, self.count = None, None, 0
