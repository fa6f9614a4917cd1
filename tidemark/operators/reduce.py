"""Compact states: the strongest bins of a spectrum, with invariants, bounds and gates.

Bins stay in their array: selection, energies and profiles are higher-order
functions, so a frame never leaves its row.  The error of a reduced frame is
that of the dropped bins (Parseval), which needs no inverse transform.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import number_string, threshold_score
from ..functions.vectors import band_profile, bound, by_band, circular_spread, default_edges, energy, l1
from ..plans.policies import Compression


def by_strength(bins: Column) -> Column:
    """Bins by falling magnitude, then rising k."""
    return F.array_sort(bins, lambda a, b: F.when(a["magnitude"] > b["magnitude"], -1).when(a["magnitude"] < b["magnitude"], 1).when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))


def ranked(spectrum: Column, policy: Compression) -> Column:
    """All selectable bins in the order in which a growing budget takes them."""
    dc = F.filter(spectrum, lambda b: b["k"] == 0) if policy.include_dc else F.slice(spectrum, 1, 0)
    others = by_strength(F.filter(spectrum, lambda b: b["k"] != 0))
    if policy.selection_method == "band_quota" and policy.quota_edges and len(policy.quota_edges) >= 2:
        edges, least = policy.quota_edges, policy.min_bins_per_band
        within = lambda lo, hi: F.filter(others, lambda b: (b["freq_hz"] >= lo) & (b["freq_hz"] < hi))
        quota = F.concat(*[F.slice(within(lo, hi), 1, least) for lo, hi in zip(edges, edges[1:], strict=False)])
        taken = F.transform(quota, lambda b: b["k"])
        others = F.concat(quota, F.filter(others, lambda b: ~F.array_contains(taken, b["k"])))
    return F.concat(dc, others)


def dropped_rmse(dropped: Column, size: Column) -> Column:
    """Root mean square of what the dropped bins contribute to the frame."""
    half = lambda b: (b["k"] == 0) | (2 * b["k"] == size)
    power = F.aggregate(dropped, F.lit(0.0), lambda s, b: s + F.when(half(b), b["re"] * b["re"]).otherwise(F.lit(2.0) * (b["re"] * b["re"] + b["im"] * b["im"])))
    return F.sqrt(power) / size


def reduce_spectra(spectra: DataFrame, rate: float, policy: Compression = Compression()) -> tuple[DataFrame, DataFrame]:
    """(states, refused frames).

    Budgets grow from the policy's to its maximum until the bounds hold; the
    search ends when no bin is left to add.
    """
    edges = list(policy.band_edges or policy.quota_edges or default_edges(rate))
    t = policy.thresholds
    order = F.col("ordered")
    rows = spectra.withColumn("ordered", ranked(F.col("spectrum"), policy)).withColumns({"energy_raw": energy(F.col("spectrum")), "full_profile": band_profile(F.col("spectrum"), edges)})

    def outcome(budget: Column) -> Column:
        def of(kept: Column) -> Column:
            ks = F.transform(kept, lambda b: b["k"])
            dropped = bound(ks, lambda own: F.filter(F.col("spectrum"), lambda b: ~F.array_contains(own, b["k"])))
            residual = F.when(F.col("energy_raw") == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (F.col("energy_raw") - energy(kept)) / F.col("energy_raw")))
            return F.struct(budget.alias("budget"), dropped_rmse(dropped, F.col("size")).alias("recon_rmse"), residual.alias("energy_residual"), l1(F.col("full_profile"), band_profile(kept, edges)).alias("band_profile_divergence"))

        return bound(F.slice(order, F.lit(1), budget), of)

    bounds = lambda o: (o["recon_rmse"] <= t.max_recon_rmse) & (o["energy_residual"] <= t.max_energy_residual) & (o["band_profile_divergence"] <= t.max_band_divergence)
    first = F.least(F.lit(policy.budget), F.size(order))
    last = F.greatest(first, F.least(F.lit(policy.top), F.size(order)))
    if policy.top <= policy.budget:
        rows = rows.withColumn("tried", F.array(outcome(first)))
    else:
        rows = rows.withColumn("tried", F.transform(F.sequence(first, last), outcome))
    rows = rows.withColumn("passed", F.filter("tried", bounds)).withColumn("chosen", F.coalesce(F.try_element_at("passed", F.lit(1)), F.element_at("tried", -1)))
    rows = rows.withColumn("kept_bins", F.slice(order, F.lit(1), F.col("chosen.budget")))
    good, bad = rows.where(F.size("passed") > 0), rows.where(F.size("passed") == 0)
    rmse, residual, divergence = F.col("chosen.recon_rmse"), F.col("chosen.energy_residual"), F.col("chosen.band_profile_divergence")
    text = lambda c: number_string(c)
    refused = bad.select(
        "stream_id", "w", "t0", F.lit("INVARIANCE_BOUNDS_FAILED").alias("error"),
        F.array(F.concat(F.lit("recon_rmse="), text(rmse)), F.concat(F.lit("energy_residual="), text(residual)), F.concat(F.lit("band_profile_divergence="), text(divergence))).alias("reasons"),
    )
    identity, power, band = threshold_score(rmse, t.max_recon_rmse), threshold_score(residual, t.max_energy_residual), threshold_score(divergence, t.max_band_divergence)
    states = good.select(
        "stream_id", "w",
        F.col("t0").alias("t_start"),
        (F.col("t0") + F.col("size") / F.lit(float(rate))).alias("t_end"),
        F.lit(1).cast("long").alias("window_count"),
        F.lit(float(rate)).alias("rate"), "size",
        (F.lit(float(rate)) / F.col("size")).alias("df"),
        F.size("spectrum").alias("bin_count_full"),
        F.size("kept_bins").alias("bin_count_kept"),
        "kept_bins", "energy_raw",
        F.when(F.col("energy_raw") == 0, F.lit(0.0)).otherwise(energy(F.col("kept_bins")) / F.col("energy_raw")).alias("energy_norm"),
        band_profile(F.col("kept_bins"), edges).alias("profile"),
        phase_spread(F.col("kept_bins"), edges).alias("sigma_phi"),
        rmse.alias("recon_rmse"), residual.alias("energy_residual"), divergence.alias("band_profile_divergence"), "parseval_error",
        identity.alias("confidence_identity"), power.alias("confidence_energy"), band.alias("confidence_band"),
        F.least(identity, power, band).alias("confidence"),
    )
    return gates(states), refused


def phase_spread(bins: Column, edges: list[float]) -> Column:
    """Circular spread of the phases in each band."""
    return by_band(bins, edges, lambda b: b["phase"], circular_spread)


def gates(states: DataFrame, novelty: Column | None = None) -> DataFrame:
    """Adds ``blocked_reason``, ``passes_invariance_bounds`` and ``eligible_for_archive_tier``."""
    least = F.least("confidence_identity", "confidence_energy", "confidence_band")
    weakest = F.when(least == F.col("confidence_identity"), F.lit("low_identity")).when(least == F.col("confidence_energy"), F.lit("low_energy")).otherwise(F.lit("low_band"))
    reason = F.when(F.col("confidence") < 1, weakest).otherwise(F.lit("none"))
    if novelty is not None:
        reason = F.when(novelty, F.lit("novelty_boundary")).otherwise(reason)
    return states.withColumn("blocked_reason", reason).withColumns({"passes_invariance_bounds": F.col("blocked_reason") == "none", "eligible_for_archive_tier": F.col("confidence") >= 0.75})
