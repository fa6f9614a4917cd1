"""Timing and value receipts of sample streams.

All per-stream statistics share one partitioning by stream: differences come
from a lag in source order, order statistics from ranks of the differences, so
no stream is ever gathered into an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, half_up
from ..plans.policies import Ingest


def differences(samples: DataFrame) -> DataFrame:
    """Adds ``t_prev``, ``v_prev`` and ``dt`` in source order; null for a stream's first sample."""
    order = Window.partitionBy("stream_id").orderBy("seq")
    return samples.withColumns({"t_prev": F.lag("t").over(order), "v_prev": F.lag("v").over(order)}).withColumn("dt", F.col("t") - F.col("t_prev"))


def with_median(rows: DataFrame) -> DataFrame:
    """Adds the ranks ``dt_rank`` (from 1, of ``dt_count``) and ``dt_nominal``, the median of the positive differences."""
    stream = Window.partitionBy("stream_id")
    ranked = rows.withColumn("dt_rank", F.when(F.col("dt").isNotNull(), F.row_number().over(stream.orderBy(F.col("dt").asc_nulls_last(), "seq"))))
    ranked = ranked.withColumns({"dt_count": F.count("dt").over(stream), "dt_least": F.count_if(F.col("dt") <= 0).over(stream)})
    place, positive = F.col("dt_rank") - F.col("dt_least"), F.col("dt_count") - F.col("dt_least")
    low, high = F.floor((positive + 1) / 2), F.floor((positive + 2) / 2)
    middle = lambda at: F.max(F.when((F.col("dt") > 0) & (place == at), F.col("dt"))).over(stream)
    return ranked.withColumn("dt_nominal", F.when(low == high, middle(low)).otherwise((middle(low) + middle(high)) / 2)).drop("dt_least")


def confidence(violations: Column, duplicates: Column, gaps: Column, jitter: Column, nominal: Column, n: Column) -> Column:
    """1 less half for any violation, and up to 0.2 each for duplicates, gaps and relative jitter."""
    share = lambda k: F.least(F.lit(0.2), k / n)
    score = F.lit(1.0) - F.when(violations > 0, F.lit(0.5)).otherwise(F.lit(0.0)) - F.when(duplicates > 0, share(duplicates)).otherwise(F.lit(0.0)) - F.when(gaps > 0, share(gaps)).otherwise(F.lit(0.0))
    score = score - F.when((nominal != 0) & jitter.isNotNull(), F.least(F.lit(0.2), F.abs(jitter / nominal))).otherwise(F.lit(0.0))
    return F.when(n <= 1, F.lit(0.0)).otherwise(clamp(score))


def receipts(samples: DataFrame, policy: Ingest = Ingest()) -> DataFrame:
    """One row a stream: the ingest and sequence receipts, ``error`` and ``reasons`` where it is refused."""
    rows = with_median(differences(samples))
    dt, nominal = F.col("dt"), F.col("dt_nominal")
    off = dt - nominal
    gap = dt > nominal * policy.gap_threshold_multiplier
    at = lambda p: F.max(F.when(F.col("dt_rank") == F.floor(F.lit(p) * (F.col("dt_count") - 1)) + 1, dt))
    out = rows.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.min_by("t", "seq").alias("t_first"),
        F.max_by("t", "seq").alias("t_last"),
        F.max("dt_nominal").alias("dt_nominal_guess"),
        at(0.50).alias("dt_p50"),
        at(0.95).alias("dt_p95"),
        at(0.99).alias("dt_p99"),
        F.sqrt(F.avg(F.when(nominal.isNull() & dt.isNotNull(), F.lit(0.0)).otherwise(off * off))).alias("jitter_rms"),
        F.count_if(gap).alias("gap_count"),
        F.coalesce(F.sum(F.when(gap, off)), F.lit(0.0)).alias("gap_total_duration"),
        F.coalesce(F.sum(F.when(gap, F.greatest(F.lit(0), half_up(dt / nominal) - 1))), F.lit(0)).cast("long").alias("missing_estimated_samples"),
        F.count_if(dt == 0).alias("duplicate_timestamps"),
        F.count_if(dt <= 0).alias("monotonicity_violations"),
        F.min("v").alias("value_min"),
        F.max("v").alias("value_max"),
        F.avg("v").alias("value_mean"),
        F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("value_rms"),
        F.count_if(F.col("t").isNull() | F.isnan("t")).alias("__bad_t"),
        F.count_if(F.col("v").isNull() | F.isnan("v")).alias("__bad_v"),
    )
    violations = F.col("monotonicity_violations")
    out = out.withColumn("segment_count", F.when(violations > 0, violations + 1).otherwise(F.lit(1)).cast("long"))
    out = out.withColumn("ingest_confidence", confidence(violations, F.col("duplicate_timestamps"), F.col("gap_count"), F.col("jitter_rms"), F.col("dt_nominal_guess"), F.col("total_samples")))
    invalid = F.array_compact(F.array(F.when(F.col("__bad_t") > 0, F.lit("timestamps contain non-numeric values")), F.when(F.col("__bad_v") > 0, F.lit("values contain non-numeric values"))))
    refused = (violations > 0) & F.lit(not policy.allow_non_monotonic)
    error = F.when(F.size(invalid) > 0, F.lit("VALIDATION_FAILED")).when(refused, F.lit("NON_MONOTONIC_TIME"))
    reasons = F.when(F.size(invalid) > 0, invalid).when(refused, F.array(F.format_string("monotonicity violations detected: %d", violations))).otherwise(F.array().cast("array<string>"))
    return out.withColumns({"error": error, "reasons": reasons}).drop("__bad_t", "__bad_v")
