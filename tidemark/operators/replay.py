"""Signals rebuilt from stored states: a sum over kept bins at each sample."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import hann_compensated
from ..functions.vectors import lower_rank
from ..plans.policies import Replay


def noise_floor(bins) -> F.Column:
    """Lower 10th percentile of the magnitudes; 0 without bins."""
    return F.coalesce(lower_rank(F.array_sort(F.transform(bins, lambda b: F.abs(b["magnitude"]))), 0.1), F.lit(0.0))


def replay(states: DataFrame, policy: Replay = Replay(), normalization: str = "forward_1_over_N", keys: tuple[str, ...] = ("stream_id", "w")) -> DataFrame:
    """``keys, n, t, v`` for every sample of every state.

    A bin between 0 and half the frame stands for its mirror image too; bins
    that weren't kept are 0, or the state's noise floor.
    """
    size = F.col("size")
    factor = {"forward_1_over_N": F.lit(1.0), "unitary": F.lit(1.0) / F.sqrt(size)}.get(normalization, F.lit(1.0) / size)
    bins = F.transform("kept_bins", lambda b: F.struct(b["k"].alias("k"), b["re"].alias("re"), b["im"].alias("im")))
    if policy.fill_missing_bins == "NOISE_FLOOR":
        have = F.transform("kept_bins", lambda b: b["k"])
        absent = F.filter(F.sequence(F.lit(0), F.floor(size / 2).cast("int")), lambda k: ~F.array_contains(have, k))
        bins = F.concat(bins, F.transform(absent, lambda k: F.struct(k.alias("k"), noise_floor(F.col("kept_bins")).alias("re"), F.lit(0.0).alias("im"))))
    start = F.col("t_start") if policy.t0_override is None else F.lit(float(policy.t0_override))
    rows = states.where(F.size("kept_bins") > 0).withColumn("bins", bins)
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(0), size - 1)))

    def part(total, b):
        angle = F.lit(2 * math.pi) * b["k"] * F.col("n") / size
        once = (b["k"] == 0) | (2 * b["k"] >= size)
        value = b["re"] * F.cos(angle) - b["im"] * F.sin(angle)
        return total + F.when(once, value).otherwise(2.0 * value)

    value = F.aggregate("bins", F.lit(0.0), part) * factor
    if policy.window_compensation == "HANN_COMPENSATE":
        value = hann_compensated(value, F.col("n"), size)
    return rows.select(*keys, "n", (start + F.col("n") / F.col("rate")).alias("t"), value.alias("v"))


def receipts(states: DataFrame, policy: Replay = Replay(), normalization: str = "forward_1_over_N", artifact_class: str = "H1", keys: tuple[str, ...] = ("stream_id", "w")) -> DataFrame:
    """Energy and settings of each replay."""
    mode = {"H1": "window_direct", "M1": "merged_lens"}.get(artifact_class, "generic")
    out = replay(states, policy, normalization, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.sum(F.col("v") * F.col("v")).alias("reconstructed_energy"))
    return out.withColumns({"replay_mode": F.lit(mode), "normalization_mode_applied": F.lit(normalization), "missing_bin_policy": F.lit(policy.fill_missing_bins), "window_compensation": F.lit(policy.window_compensation)})
