"""Descriptors of band profiles and of measures over scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concentration(profile: Column, least: float = 0.05) -> Column:
    """Struct: ratio of the two greatest shares, the greatest one's place, how many reach ``least``, entropy in nats."""
    ordered = F.reverse(F.array_sort(profile))
    second = F.try_element_at(ordered, F.lit(2))
    share = lambda s, x: s + F.when(x > 0, -x * F.ln(x)).otherwise(F.lit(0.0))
    return F.struct(
        F.when(second > 0, F.element_at(ordered, 1) / second).alias("top_ratio"),
        (F.array_position(profile, F.array_max(profile)) - 1).cast("int").alias("dominant"),
        F.size(F.filter(profile, lambda x: x >= least)).alias("nontrivial"),
        F.aggregate(profile, F.lit(0.0), share).alias("entropy"),
    )


def normalised(distance: Column, size: Column, how: str, entropy: Column | None = None) -> Column:
    """A distance scaled for its frame size: by bin width, root of the size, or entropy."""
    if how == "bin_width":
        return distance / size
    if how == "sqrt_n":
        return distance / F.sqrt(size)
    return F.when(entropy > 0, distance / entropy).otherwise(distance)


def relative_to_median(value: Column, values: Column) -> Column:
    """value / median of the values; 0 where the median is 0."""
    s, n = F.array_sort(values), F.size(values)
    middle = (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor((n + 2) / 2).cast("int"))) / 2
    return F.when(middle == 0, F.lit(0.0)).otherwise(value / middle)


#: From where two measures count as separated, and as borderline (fixed values).
LEVELS = {"band_profile_distance": (0.20, 0.08), "absolute_energy_ratio": (1.50, 1.10)}


def separation(metric: str, value: Column) -> Column:
    """separated, borderline or similar; a ratio reaches its level, a distance must pass it."""
    if metric not in LEVELS:
        return F.when(value.isNull(), F.lit("unknown")).otherwise(F.lit("unclassified"))
    high, low = LEVELS[metric]
    passes = (lambda at: value >= at) if metric == "absolute_energy_ratio" else (lambda at: value > at)
    return F.when(value.isNull(), F.lit("unknown")).when(passes(high), F.lit("separated")).when(passes(low), F.lit("borderline")).otherwise(F.lit("similar"))


def scale_behaviour(consistency: Column, stability: Column, drift: Column, scales: Column) -> Column:
    """How a measure behaves over scales: kept, changed by a law, gone, or neither."""
    steady = (stability < 0.05) & (drift == "flat")
    return (
        F.when(scales < 2, F.lit("insufficient_scales")).when(consistency == 0, F.lit("collapse")).when(consistency == 1, F.when(steady, F.lit("persistence")).otherwise(F.lit("lawful_transformation")))
    ).otherwise(F.lit("fragmentation_consolidation"))


def scale_pattern(separated: Column, total: Column) -> Column:
    """In how many of the scales a pair is separated."""
    share = F.when(total > 0, separated / total).otherwise(F.lit(0.0))
    return F.when(share == 1, F.lit("always_separated")).when(share == 0, F.lit("always_similar")).when(share >= 0.75, F.lit("mostly_separated")).when(share <= 0.25, F.lit("mostly_similar")).otherwise(F.lit("mixed"))


def scale_thresholds(pairs: DataFrame, by: str = "scale") -> DataFrame:
    """Per scale, from pairs with a ``value`` and whether they are known to be ``similar``: the middle of the gap, or the upper median where there is none."""
    values = F.array_sort(F.collect_list("value"))
    rows = pairs.groupBy(by).agg(F.coalesce(F.max(F.when(F.col("similar"), F.col("value"))), F.lit(0.0)).alias("max_similar"), F.coalesce(F.min(F.when(~F.col("similar"), F.col("value"))), F.lit(1.0)).alias("min_separated"), values.alias("__all"))
    gap = F.col("min_separated") > F.col("max_similar")
    middle = F.element_at("__all", F.floor(F.size("__all") / 2).cast("int") + 1)
    return rows.select(by, F.when(gap, (F.col("max_similar") + F.col("min_separated")) / 2).otherwise(middle).alias("threshold"), gap.alias("clean_gap"), "max_similar", "min_separated")
