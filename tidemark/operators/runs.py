"""Whole runs compared: signatures, pairwise similarity, reproducibility."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l1

#: Bounds within which two runs count as alike (fixed values): differences of evidence, then distances.
EVIDENCE = {"h1_count": 2, "m1_count": 2, "anomaly_count": 1, "query_present": 0, "state_count": 2, "basin_count": 1, "segment_count": 0, "total_transitions": 2, "total_re_entries": 1, "novelty_gate_count": 1, "new_frequency_event_count": 2, "energy_shift_event_count": 2}
SUPPORT = {"h1_band_profile_distance": 0.2, "m1_band_profile_distance": 0.2, "basin_band_profile_distance": 0.2, "dominant_frequency_delta": 1.0, "state_duration_delta": 0.5, "transition_density_delta": 0.2, "recurrence_delta": 1, "basin_radius_delta": 0.25, "basin_member_count_delta": 1}
HIGH, MEDIUM = 0.75, 0.45
PROFILES = {"h1_band_profile_distance": "h1_band_profile_mean", "m1_band_profile_distance": "m1_band_profile_mean", "basin_band_profile_distance": "basin_band_profile_mean"}
SCALARS = {"dominant_frequency_delta": "dominant_frequency_hz_mean", "state_duration_delta": "state_duration_sec_mean", "transition_density_delta": "transition_density", "recurrence_delta": "recurrence_mean", "basin_radius_delta": "basin_radius_mean", "basin_member_count_delta": "basin_member_count_mean"}


def mean_profile(states: DataFrame, by: str, profile: str, out: str) -> DataFrame:
    """Element-wise mean of profiles of one width; an empty array where widths differ or there are none."""
    rows = states.where(F.size(profile) > 0)
    widths = rows.groupBy(by).agg(F.min(F.size(profile)).alias("lo"), F.max(F.size(profile)).alias("hi"))
    means = rows.select(by, F.posexplode(profile).alias("band", "x")).groupBy(by, "band").agg(F.avg("x").alias("x"))
    vectors = means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "x"))), lambda b: b["x"]).alias("v"))
    return widths.join(vectors, by).select(by, F.when(F.col("lo") == F.col("hi"), F.col("v")).otherwise(F.array().cast("array<double>")).alias(out))


def dominant_frequency(bins: Column) -> Column:
    """Frequency of the strongest bin other than DC, else of DC."""
    strongest = lambda xs: F.try_element_at(F.array_sort(xs, lambda a, b: F.when(a["magnitude"] > b["magnitude"], -1).when(a["magnitude"] < b["magnitude"], 1).otherwise(a["k"] - b["k"])), F.lit(1))["freq_hz"]
    return F.coalesce(strongest(F.filter(bins, lambda b: b["k"] != 0)), strongest(bins))


def vector_distance(a: Column, b: Column) -> Column:
    """0 for two empty vectors, 1 for different widths, else the sum of absolute differences."""
    a, b = (F.coalesce(x, F.array().cast("array<double>")) for x in (a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(0.0)).when(F.size(a) != F.size(b), F.lit(1.0)).otherwise(l1(a, b))


def gap(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    return F.abs(F.coalesce(a.cast("double"), zero) - F.coalesce(b.cast("double"), zero))


def label(ratio: Column) -> Column:
    return F.when(ratio >= HIGH, F.lit("high")).when(ratio >= MEDIUM, F.lit("medium")).otherwise(F.lit("low"))


def ratio(checks: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in checks]) / F.lit(float(len(checks)))


def pairs(signatures: DataFrame) -> DataFrame:
    """Each pair of runs (``run_a`` before ``run_b`` by ``run_idx``): distances, similarity ratio and label.

    Runs are few beside their states; the join is over one row a run.
    """
    side = lambda s: signatures.select(*[F.col(c).alias(f"{c}_{s}") for c in signatures.columns])
    rows = side("a").join(side("b"), F.col("run_idx_a") < F.col("run_idx_b"))
    have = set(signatures.columns)
    col = lambda c, s: F.col(f"{c}_{s}") if c in have else F.lit(None)
    apart = {d: vector_distance(col(c, "a").cast("array<double>"), col(c, "b").cast("array<double>")) for d, c in PROFILES.items()} | {d: gap(col(c, "a"), col(c, "b")) for d, c in SCALARS.items()}
    deltas = {f"{c}_delta": gap(col(c, "a"), col(c, "b")) for c in EVIDENCE}
    rows = rows.withColumns(apart | deltas)
    near = lambda c, most: F.col(c) <= most
    rows = rows.withColumn("similarity_ratio", ratio([near(f"{c}_delta", m) for c, m in EVIDENCE.items()] + [near(c, m) for c, m in SUPPORT.items()]))
    part = lambda names: ratio([near(n, EVIDENCE[n.removesuffix("_delta")] if n.removesuffix("_delta") in EVIDENCE else SUPPORT[n]) for n in names])
    rows = rows.withColumns(
        {
            "similarity": label(F.col("similarity_ratio")),
            "count_ratio": part(["h1_count_delta", "m1_count_delta", "anomaly_count_delta", "state_count_delta", "basin_count_delta", "segment_count_delta"]),
            "support_ratio": part(["h1_band_profile_distance", "m1_band_profile_distance", "basin_band_profile_distance", "dominant_frequency_delta", "state_duration_delta"]),
            "transition_ratio": part(["total_transitions_delta", "total_re_entries_delta", "transition_density_delta", "recurrence_delta"]),
            "basin_ratio": part(["basin_count_delta", "basin_radius_delta", "basin_member_count_delta"]),
        }
    )
    return rows.select(F.col("run_label_a").alias("run_a"), F.col("run_label_b").alias("run_b"), *apart, *deltas, "similarity_ratio", "similarity", "count_ratio", "support_ratio", "transition_ratio", "basin_ratio")


def reproducibility(compared: DataFrame) -> DataFrame:
    """One row: labels of the pairs' mean ratios, and flags; no pair means insufficient data."""
    kinds = {"count": "count_ratio", "support_profile": "support_ratio", "transition": "transition_ratio", "basin": "basin_ratio", "overall": "similarity_ratio"}
    one = compared.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(k) for k, c in kinds.items()], F.count_if(F.col("similarity") == "low").alias("low"), F.count_if(F.col("similarity") == "high").alias("high"))
    none = F.col("n") == 0
    named = {f"{k}_reproducibility": F.when(none, F.lit("insufficient_data")).otherwise(label(F.col(k))) for k in kinds}
    one = one.withColumns(named)
    flag = {"overall": "cross_run_reproducible", "support_profile": "support_profile_stable", "count": "structural_support_stable", "transition": "transition_pattern_stable", "basin": "basin_profile_stable"}
    flags = [F.when(F.col(f"{k}_reproducibility") == "high", F.lit(name)) for k, name in flag.items()]
    flags += [F.when(F.col("low") > 0, F.lit("run_divergence_detected")), F.when((F.col("high") == F.col("n")) & ~none, F.lit("high_pairwise_agreement"))]
    return one.withColumn("dynamics_flags", F.array_compact(F.array(*flags))).select(*named, "dynamics_flags", F.col("n").alias("pair_count"))


def register(runs: DataFrame, new: DataFrame, most: int = 25) -> DataFrame:
    """Known runs and those of ``new`` whose label isn't taken; the newest ``most`` stay."""
    both = runs.unionByName(new.join(runs.select("run_label"), "run_label", "left_anti"))
    return both.orderBy(F.desc("run_idx")).limit(most)
