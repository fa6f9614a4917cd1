"""Replay requests judged by the support they have: thresholds, downgrades, fidelity, trace.

A request is a row; everything is a column of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Downgrades, non-claims and outcome names (fixed values).
DEGRADED, INSUFFICIENT, UNJUSTIFIED = "support_degraded", "retained_tier_insufficient", "reconstruction_not_justified"
NON_CLAIMS = ["not raw restoration", "not truth", "not canon", "not promotion", "not ontology", "not equivalent to original source signal", "not operator reversal", "not source-adjacent reconstitution"]


def _yes(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def evaluate(requests: DataFrame) -> DataFrame:
    """Adds status, threshold outcome, downgrade, tier sufficiency, mechanization and both postures.

    Columns read: ``request_status, replay_type, target_type, target_ref,
    target_request_type, tier`` (null: 0), ``run_ok, has_bundle,
    has_runtime_support, receipt_refs`` (array), ``provenance_complete,
    replayable_support``.
    """
    tier = F.coalesce("tier", F.lit(0))
    receipts = (F.size(F.coalesce("receipt_refs", F.array().cast("array<string>"))) > 0) & _yes("provenance_complete") & _yes("replayable_support")
    runtime = _yes("run_ok") & _yes("has_runtime_support")
    is_request = F.coalesce(F.col("replay_type") == "request_support_replay", F.lit(False))
    context = ~is_request | (F.col("target_ref").isNotNull() & F.col("target_request_type").isNotNull())
    failure = (
        F.when(F.col("request_status") == "failed", F.lit("replay request has status 'failed'"))
        .when(F.coalesce("target_type", F.lit("unknown")) == "unknown", F.lit("replay target type cannot be resolved"))
        .when((tier == 0) & ~runtime, F.lit("runtime replay requires live runtime support"))
        .when((tier == 1) & ~receipts, F.lit("Tier 1 replay requires receipt-backed lineage support"))
    )
    rows = requests.withColumns({"failure_reason": failure, "receipt_support": receipts, "runtime_support": runtime, "request_context": context})
    failed = F.col("failure_reason").isNotNull()
    supported = ((tier == 0) & _yes("has_bundle") & runtime) | ((tier == 1) & receipts)
    downgrade = F.when(failed, F.lit(UNJUSTIFIED)).when(is_request & ~context, F.lit(DEGRADED)).when(tier >= 2, F.lit(INSUFFICIENT)).when((tier == 1) & ~receipts, F.lit(INSUFFICIENT)).when((tier == 0) & ~runtime, F.lit(UNJUSTIFIED))
    rows = rows.withColumns({"supported": supported & ~failed, "downgrade_output": downgrade})
    outcome = F.coalesce("downgrade_output", F.when(F.col("supported"), F.lit("bounded_supported")).otherwise(F.lit("support_unresolved")))
    rows = rows.withColumns(
        {
            "reconstruction_status": F.when(failed, F.lit("failed")).when(F.col("downgrade_output").isNotNull(), F.lit("downgraded")).otherwise(F.lit("completed")),
            "threshold_outcome": outcome,
            "retained_tier_sufficiency": F.when(failed | (tier >= 2), F.lit("fail")).when(F.col("supported"), F.lit("pass")).otherwise(F.lit("unknown")),
            "distortion_posture": F.when(failed, F.lit("fail")).when(F.col("supported"), F.lit("pass")).otherwise(F.lit("warning")),
            "mechanization_status": F.when(failed, F.lit("failed")).when(F.col("downgrade_output").isNotNull() | (tier > 1), F.lit("partially_mechanized")).otherwise(F.lit("mechanized")),
        }
    )
    return rows.withColumns({"threshold_class": threshold_class(F.col("reconstruction_status"), F.col("downgrade_output"), F.col("threshold_outcome"))}).withColumn("fidelity_class", fidelity_class(F.col("threshold_class")))


def threshold_class(status: Column, downgrade: Column, outcome: Column) -> Column:
    """How a replay stands, the gravest finding first."""
    return (
        F.when(status == "failed", F.lit("failed"))
        .when(downgrade == DEGRADED, F.lit("degraded"))
        .when(downgrade == INSUFFICIENT, F.lit("insufficient"))
        .when(downgrade == UNJUSTIFIED, F.lit("not_justified"))
        .when((outcome == "support_unresolved") | (status == "prepared"), F.lit("unresolved"))
        .otherwise(F.lit("supported"))
    )


def fidelity_class(threshold: Column) -> Column:
    return F.concat(F.when(threshold == "supported", F.lit("bounded")).otherwise(threshold), F.lit("_support_trace"))


def trace(evaluated: DataFrame) -> DataFrame:
    """Adds ``trace``: the steps a replay took, with ok, warning or failed."""
    tier = F.coalesce("tier", F.lit(0))
    step = lambda kind, good=None: F.struct(F.lit(kind).alias("step_type"), (F.lit("ok") if good is None else F.when(good, F.lit("ok")).otherwise(F.lit("warning"))).alias("status"))
    have = set(evaluated.columns)
    col = lambda c: F.col(c).isNotNull() if c in have else F.lit(False)
    early = [F.when(F.col("request_status") != "failed", step("replay_request_received")), F.when((F.col("request_status") != "failed") & (F.coalesce("target_type", F.lit("unknown")) != "unknown"), step("target_resolved"))]
    known = (F.col("request_status") != "failed") & (F.coalesce("target_type", F.lit("unknown")) != "unknown")
    middle = [F.when(known, s) for s in (step("lens_declared", col("lens")), step("retained_tier_declared", tier <= 1), step("lineage_bound", col("stream_id")), step("runtime_support_collected", F.col("runtime_support")), step("receipt_support_collected", F.col("receipt_support")))]
    failed = F.col("reconstruction_status") == "failed"
    context = F.when(F.col("request_context"), step("request_context_bound")).otherwise(step("request_context_absent", F.lit(False)))
    last = F.when(F.col("reconstruction_status") == "downgraded", step("reconstruction_downgraded", F.lit(False))).otherwise(step("reconstruction_completed"))
    late = [F.when(~failed, step("scale_latency_declared")), F.when(~failed, context), F.when(~failed, last), F.when(failed, F.struct(F.lit("reconstruction_failed").alias("step_type"), F.lit("failed").alias("status")))]
    return evaluated.withColumn("trace", F.array_compact(F.array(*early, *middle, *late)))


def non_claims(given: Column) -> Column:
    """A request's own non-claims, and the standing ones it lacks."""
    own = F.coalesce(given, F.array().cast("array<string>"))
    return F.concat(own, F.array_except(F.array(*map(F.lit, NON_CLAIMS)), own))
