"""Consolidation of neighbouring states into one."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import number_string, threshold_score, wrapped_phase
from ..functions.vectors import band_profile, bound, default_edges, energy, l1
from ..plans.policies import Compression, Merge
from .reduce import by_strength, phase_spread


def pairs(states: DataFrame) -> DataFrame:
    """Adds ``pair`` (from 0) for the 1st and 2nd, 3rd and 4th ... state of each segment; an odd last one is left out."""
    order = Window.partitionBy("stream_id", "segment_id").orderBy("w")
    placed = states.withColumn("pair", F.floor((F.row_number().over(order) - 1) / 2).cast("long"))
    both = F.count(F.lit(1)).over(Window.partitionBy("stream_id", "segment_id", "pair"))
    return placed.withColumn("__both", both).where("__both = 2").drop("__both")


def rotate(bins: Column, shift: Column) -> Column:
    """Bins turned by their phase over a time shift."""

    def turned(b: Column) -> Column:
        angle = F.lit(-2 * math.pi) * b["freq_hz"] * shift
        re = b["re"] * F.cos(angle) - b["im"] * F.sin(angle)
        im = b["re"] * F.sin(angle) + b["im"] * F.cos(angle)
        point = F.struct(re.alias("re"), im.alias("im"))
        return bound(point, lambda z: F.struct(b["k"].alias("k"), b["freq_hz"].alias("freq_hz"), z["re"].alias("re"), z["im"].alias("im"), F.hypot(z["re"], z["im"]).alias("magnitude"), F.atan2(z["im"], z["re"]).alias("phase")))

    return F.transform(bins, turned)


def eligibility(states: Column, policy: Merge, policy_ids: Column | None = None) -> Column:
    """Reasons why states (in order of time) can't be merged; empty if they can."""
    first, rest, n = F.element_at(states, 1), F.slice(states, 2, 1 << 20), F.size(states)
    differs = lambda c: F.exists(rest, lambda s: s[c] != first[c])
    out = []
    if policy.merge_mode == "authoritative":
        if policy_ids is not None:
            out.append(F.when(F.size(F.array_distinct(policy_ids)) > 1, F.lit("authoritative merge requires identical policies")))
        for c in ("stream_id", "segment_id"):
            out.append(F.when(differs(c), F.lit(f"authoritative merge requires same {c}")))
    for c, name in (("rate", "Fs_target"), ("size", "N"), ("df", "df")):
        out.append(F.when(differs(c), F.lit(f"{name} mismatch")))
    following = F.zip_with(F.slice(states, F.lit(1), n - 1), rest, lambda a, b: F.struct(a["t_end"].alias("end"), b["t_start"].alias("start")))
    if policy.adjacency_rule == "strict_adjacent":
        out.append(F.when(F.exists(following, lambda p: p["start"] < p["end"]), F.lit("strict_adjacent merge does not allow overlap")))
    elif policy.adjacency_rule == "time_touching":
        gap = F.try_element_at(F.filter(following, lambda p: p["start"] > p["end"] + policy.grid_tolerance), F.lit(1))
        out.append(F.when(gap.isNotNull(), F.concat(F.lit("time_touching merge requires contiguous windows; gap detected between t="), number_string(gap["end"]), F.lit(" and t="), number_string(gap["start"]))))
    elif policy.adjacency_rule:
        out.append(F.lit(f'adjacency_rule="{policy.adjacency_rule}" is not implemented'))
    if policy.novelty_gate == "strict":
        out.append(F.when(F.exists(states, lambda s: s["blocked_reason"] == "novelty_boundary"), F.lit("novelty boundary blocks merge")))
    return F.array_compact(F.array(*out))


def merge(groups: DataFrame, rate: float, policy: Merge = Merge(), compression: Compression = Compression()) -> tuple[DataFrame, DataFrame]:
    """(merged states, refused groups) of rows ``stream_id, segment_id, pair`` and ``states``: an array of state structs.

    A frequency's mean is over the states that have it; the whole merge is one
    expression over the row's arrays.
    """
    edges = list(compression.band_edges or compression.quota_edges or default_edges(rate))
    ordered = F.array_sort(F.col("states"), lambda a, b: F.when(a["t_start"] < b["t_start"], -1).when(a["t_start"] > b["t_start"], 1).otherwise(0))
    rows = groups.withColumn("states", ordered).withColumn("reasons", eligibility(F.col("states"), policy))
    refused = rows.where(F.size("reasons") > 0).select("stream_id", "segment_id", "pair", F.lit("MERGE_INELIGIBLE").alias("error"), "reasons")
    good = rows.where(F.size("reasons") == 0)
    first, last = F.element_at("states", 1), F.element_at("states", -1)
    weight = lambda s: (s["t_end"] - s["t_start"]) * (s["confidence"] if policy.weights_mode == "duration_quality" else F.lit(1.0))
    turn = (lambda s: rotate(s["kept_bins"], s["t_start"] - first["t_start"])) if policy.phase_alignment_mode == "clock_delta_rotation" else (lambda s: s["kept_bins"])
    good = good.withColumn("weights", F.transform("states", weight)).withColumn("turned", F.transform("states", turn))
    tagged = F.flatten(F.zip_with("turned", "weights", lambda bins, w: F.transform(bins, lambda b: F.struct(b["k"].alias("k"), b["freq_hz"].alias("freq_hz"), (w * b["re"]).alias("re"), (w * b["im"]).alias("im"), w.alias("w")))))
    good = good.withColumn("tagged", tagged)
    ks = F.array_sort(F.array_distinct(F.transform("tagged", lambda b: b["k"])))

    def mean(k: Column) -> Column:
        def of(mine: Column) -> Column:
            part = lambda c: F.aggregate(mine, F.lit(0.0), lambda s, b: s + b[c])
            share = lambda c: F.when(part("w") == 0, F.lit(0.0)).otherwise(part(c) / part("w"))
            point = F.struct(share("re").alias("re"), share("im").alias("im"))
            return bound(point, lambda z: F.struct(k.alias("k"), F.element_at(mine, 1)["freq_hz"].alias("freq_hz"), z["re"].alias("re"), z["im"].alias("im"), F.hypot(z["re"], z["im"]).alias("magnitude"), F.atan2(z["im"], z["re"]).alias("phase")))

        return bound(F.filter("tagged", lambda b: b["k"] == k), of)

    good = good.withColumn("full", F.transform(ks, mean))
    dc = F.filter("full", lambda b: b["k"] == 0) if compression.include_dc else F.slice("full", 1, 0)
    kept = F.slice(F.concat(dc, by_strength(F.filter("full", lambda b: b["k"] != 0))), 1, compression.budget)
    weights = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w)
    mean_of = lambda get: F.when(weights == 0, F.lit(0.0)).otherwise(F.aggregate(F.zip_with("states", "weights", lambda s, w: w * get(s)), F.lit(0.0), lambda s, x: s + x) / weights)
    bands = len(edges) - 1
    expected = F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda i: mean_of(lambda s: F.coalesce(F.try_element_at(s["profile"], i), F.lit(0.0))))
    good = good.withColumns({"kept_bins": kept, "energy_raw": energy(F.col("full")), "profile": band_profile(F.col("full"), edges), "expected_energy": mean_of(lambda s: s["energy_raw"]), "expected_profile": expected})
    drift = F.abs(F.col("energy_raw") - F.col("expected_energy")) / F.greatest(F.abs(F.col("expected_energy")), F.lit(1e-12))
    good = good.withColumns({"energy_drift": drift, "band_profile_divergence": l1(F.col("profile"), F.col("expected_profile"))})
    t = compression.thresholds
    power, band = threshold_score(F.col("energy_drift"), t.max_energy_residual), threshold_score(F.col("band_profile_divergence"), t.max_band_divergence)

    def turned_by(s: Column, bins: Column) -> Column:
        moved = F.zip_with(s["kept_bins"], bins, lambda a, b: F.abs(wrapped_phase(b["phase"] - a["phase"])))
        return F.when(F.size(moved) == 0, F.lit(0.0)).otherwise(F.aggregate(moved, F.lit(0.0), lambda x, y: x + y) / F.size(moved))

    deltas = F.zip_with("states", "turned", turned_by)
    overall = F.least(F.lit(1.0), power, band)
    least = F.when(overall < 1, F.when(power <= band, F.lit("low_energy")).otherwise(F.lit("low_band"))).otherwise(F.lit("none"))
    merged = good.withColumns({"confidence": overall, "blocked_reason": least}).select(
        "stream_id", "segment_id", "pair",
        first["t_start"].alias("t_start"), last["t_end"].alias("t_end"),
        F.aggregate("states", F.lit(0).cast("long"), lambda n, s: n + s["window_count"]).alias("window_count"),
        first["rate"].alias("rate"), first["size"].alias("size"), first["df"].alias("df"),
        F.size("full").alias("bin_count_full"), F.size("kept_bins").alias("bin_count_kept"), "kept_bins", "energy_raw",
        F.when(F.col("energy_raw") == 0, F.lit(0.0)).otherwise(energy(F.col("kept_bins")) / F.col("energy_raw")).alias("energy_norm"),
        "profile", phase_spread(F.col("kept_bins"), edges).alias("sigma_phi"),
        F.col("energy_drift").alias("energy_residual"), "band_profile_divergence",
        (F.aggregate(deltas, F.lit(0.0), lambda a, b: a + b) / F.size("states")).alias("phase_align_residual"),
        F.lit(1.0).alias("confidence_identity"), power.alias("confidence_energy"), band.alias("confidence_band"), "confidence", "blocked_reason",
        (F.lit(policy.merge_mode == "authoritative") & (F.col("blocked_reason") == "none")).alias("eligible_for_authoritative_merge"),
        (F.col("confidence") >= 0.75).alias("eligible_for_archive_tier"), "weights",
        F.transform("states", lambda s: s["w"]).alias("inputs"),
    )
    return merged, refused


def basis_posture(mode: Column, blocked: Column, crosses: Column) -> Column:
    """How far a merge's basis reaches; ``crosses``: over segments or policies."""
    lens = F.when(crosses, F.lit("lens_basis | cross-boundary structural consolidation only | same-object closure deferred")).otherwise(F.lit("lens_basis | structural consolidation only | same-object closure deferred"))
    strict = F.when(blocked == "none", F.lit("authoritative_basis | strict consolidation bounds satisfied | same-object closure still deferred")).otherwise(F.concat(F.lit("authoritative_basis_narrowed | consolidation produced with "), blocked, F.lit(" stress | same-object closure deferred")))
    return F.when(mode == "lens", lens).otherwise(strict)


def scope_posture(mode: Column, crosses: Column) -> Column:
    return F.when(mode == "lens", F.when(crosses, F.lit("cross_boundary_lens_scope")).otherwise(F.lit("same_boundary_lens_scope"))).otherwise(F.lit("same_stream_same_segment_same_policy_scope"))


def adjacency_posture(rule: Column, crosses: Column) -> Column:
    local = F.when(rule == "time_touching", F.lit("local contiguous consolidation")).otherwise(F.lit("local non-overlap consolidation"))
    known = F.concat(rule, F.lit(" | "), F.when(crosses, F.lit("boundary-crossing adjacency accepted only under lens posture")).otherwise(local))
    return F.when(rule.isin("time_touching", "strict_adjacent"), known).otherwise(F.concat(F.coalesce(rule, F.lit("unspecified")), F.lit(" | adjacency posture recorded without stronger continuity claim")))
