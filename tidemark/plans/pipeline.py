"""The whole chain for any number of streams: samples to states, segments, merges, neighborhoods, trajectory.

Everything before segmentation is independent by frame; segmentation folds a
stream's small states in order; the rest groups by segment.  Tables that
several results read can be written once by the caller (``keep``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import number_string
from ..operators import align, frames, ingest, merge, neighborhoods, novelty, reduce, spectrum, trajectory
from .policies import Policies


@dataclass
class Run:
    """Tables of a run; every one has ``stream_id``."""

    receipts: DataFrame
    aligned: DataFrame
    frames: DataFrame
    states: DataFrame
    skipped: DataFrame
    transitions: DataFrame
    merged: DataFrame
    merge_failures: DataFrame
    committed: DataFrame
    neighborhoods: DataFrame
    trajectory: DataFrame
    summary: DataFrame


def state_id(kind: str) -> F.Column:
    return F.concat_ws(":", F.lit(kind), "stream_id", "segment_id", number_string(F.col("t_start")), number_string(F.col("t_end")))


def states_of(samples: DataFrame, policies: Policies) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(aligned, frames, states before segmentation, skipped frames)."""
    rate = policies.grid.rate
    aligned = align.align(samples, policies.grid)
    cut = frames.frames(aligned, policies.frame)
    _, holed = spectrum.transformable(cut)
    states, refused = reduce.reduce_spectra(spectrum.spectra(cut, rate, policies.transform), rate, policies.compression)
    audit = holed.select("stream_id", "w", "t0", F.lit("transform").alias("stage"), "error").unionByName(refused.select("stream_id", "w", "t0", F.lit("compress").alias("stage"), "error"))
    return aligned, cut, states, audit


def run(samples: DataFrame, policies: Policies, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Run:
    samples = keep(samples)
    aligned, cut, states, audit = states_of(samples, policies)
    segmented = keep(novelty.segments(states, policies.anomaly)).withColumn("state_id", state_id("H1")).withColumn("artifact_class", F.lit("H1"))
    moves = novelty.transitions(segmented)
    paired = merge.pairs(segmented)
    members = F.struct(*[c for c in segmented.columns])
    groups = paired.groupBy("stream_id", "segment_id", "pair").agg(F.collect_list(members).alias("states"))
    merged, failures = merge.merge(groups, policies.grid.rate, policies.merge, policies.merged)
    merged = keep(merged).withColumn("state_id", state_id("M1")).withColumn("artifact_class", F.lit("M1"))
    both = segmented.select("stream_id", "segment_id", "state_id", "artifact_class", "t_start", "t_end", "rate", "size", "df", "kept_bins", "energy_raw", "profile", "confidence", "novelty", F.lit(0).alias("__kind"), F.col("w").alias("__at"), F.col("epoch").alias("__seg"))
    rest = merged.select("stream_id", "segment_id", "state_id", "artifact_class", "t_start", "t_end", "rate", "size", "df", "kept_bins", "energy_raw", "profile", "confidence", F.lit(False).alias("novelty"), F.lit(1).alias("__kind"), F.col("pair").alias("__at"), F.regexp_extract("segment_id", r"(\d+)$", 1).cast("long").alias("__seg"))
    order = Window.partitionBy("stream_id").orderBy("__kind", F.when(F.col("__kind") == 0, F.lit(0)).otherwise(F.col("__seg")), "__at")
    committed = keep(both.unionByName(rest).withColumn("commit_idx", F.row_number().over(order) - 1).drop("__kind", "__at", "__seg"))
    placed = Window.partitionBy("segment_id").orderBy("t_start", "commit_idx")
    nodes = keep(committed.withColumn("node", (F.row_number().over(placed) - 1).cast("long")))
    linked = neighborhoods.single_link if policies.neighborhood.linkage == "single_link" else neighborhoods.complete_link
    labels = keep(linked(nodes, policies.neighborhood.similarity_threshold))
    clusters = neighborhoods.summaries(nodes, labels, policies.neighborhood)
    near = neighborhoods.nearest(nodes, clusters, policies.neighborhood.similarity_threshold)
    path = near.select("stream_id", F.col("commit_idx").alias("frame_index"), "t_start", "t_end", "segment_id", F.when(F.col("nearest").isNotNull(), F.concat_ws(":", "segment_id", F.col("nearest").cast("string"))).alias("basin_id"), "distance", "profile", "energy_raw", "confidence", "novelty", "state_id", "artifact_class")
    counts = committed.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("state_count"), F.count_if(F.col("artifact_class") == "H1").alias("h1_count"), F.count_if(F.col("artifact_class") == "M1").alias("m1_count"), F.count_distinct("segment_id").alias("segment_count")
    )
    reports = segmented.groupBy("stream_id").agg(F.count("base_w").alias("anomaly_count"), F.count_if("novelty").alias("segment_transition_count"))
    basins = labels.select("segment_id", "label").distinct().join(committed.select("stream_id", "segment_id").distinct(), "segment_id").groupBy("stream_id").agg(F.count(F.lit(1)).alias("basin_count"))
    total = lambda df, name: df.groupBy("stream_id").agg(F.count(F.lit(1)).alias(name))
    summary = counts.join(reports, "stream_id", "left").join(basins, "stream_id", "left").join(total(audit, "skipped_window_count"), "stream_id", "left").join(total(failures, "merge_failure_count"), "stream_id", "left").na.fill(0)
    summary = summary.withColumn("trajectory_frames", F.col("state_count"))
    return Run(ingest.receipts(samples, policies.ingest), aligned, cut, segmented, audit, moves, merged, failures, committed, clusters, path, summary)


def transition_report(result: Run) -> DataFrame:
    return trajectory.report(result.trajectory)
