"""Policies as frozen records; an id lists a policy's settings, and equal ids mean the same policy."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from ..functions.numbers import number_text as n


def _id(head: str, **parts) -> str:
    return ":".join([head, *(f"{k}={n(v)}" for k, v in parts.items())])


@dataclass(frozen=True)
class Ingest:
    policy_id: str = "ingest_policy_unversioned"
    gap_threshold_multiplier: float = 3.0
    allow_non_monotonic: bool = False
    allow_empty: bool = False


@dataclass(frozen=True)
class Grid:
    rate: float = 1.0
    t_ref: float | None = None
    grid_policy: str = "strict"
    drift_model: str = "none"
    non_monotonic_policy: str = "reject"
    interp_method: str = "linear"
    gap_policy: str = "cut"
    small_gap_multiplier: float = 3.0
    max_gap_seconds: float | None = None
    anti_alias_filter: bool = False

    def id(self, t_ref: float | None = None) -> str:
        return _id("GRID", Fs=self.rate, tref=self.t_ref if t_ref is None else t_ref, grid=self.grid_policy, drift=self.drift_model, nonmono=self.non_monotonic_policy, interp=self.interp_method, gap=self.gap_policy, smallgap=self.small_gap_multiplier, maxgap=self.max_gap_seconds, aa=self.anti_alias_filter)


@dataclass(frozen=True)
class Frame:
    rate: float = 1.0
    size: int = 64
    hop: int = 32
    mode: str = "fixed"
    window_function: str = "hann"
    overlap_ratio: float = 0
    stationarity_policy: str = "tolerant"
    salience_policy: str = "off"
    gap_policy: str = "cut"
    max_missing_ratio: float = 0.05
    boundary_policy: str = "truncate"

    def id(self) -> str:
        return _id("WIN", mode=self.mode, Fs=self.rate, N=self.size, hop=self.hop, fn=self.window_function, overlap=self.overlap_ratio, stationarity=self.stationarity_policy, salience=self.salience_policy, gap=self.gap_policy, maxmiss=self.max_missing_ratio, boundary=self.boundary_policy)


@dataclass(frozen=True)
class Transform:
    transform_type: str = "fft"
    normalization_mode: str = "forward_1_over_N"
    scaling_convention: str = "real_input_half_spectrum"
    numeric_policy: str = "tolerant"

    def id(self) -> str:
        return _id("XFORM", type=self.transform_type, norm=self.normalization_mode, scale=self.scaling_convention, numeric=self.numeric_policy)


@dataclass(frozen=True)
class Thresholds:
    max_recon_rmse: float = 0.25
    max_energy_residual: float = 0.25
    max_band_divergence: float = 0.30


@dataclass(frozen=True)
class Compression:
    policy_id: str = "unspecified"
    selection_method: str = "topK"
    budget: int = 8
    max_budget: int | None = None
    include_dc: bool = True
    invariance_lens: str = "unspecified"
    numeric_policy: str = "tolerant"
    respect_novelty_boundary: bool = True
    thresholds: Thresholds = field(default_factory=Thresholds)
    band_edges: tuple[float, ...] | None = None
    quota_edges: tuple[float, ...] | None = None
    min_bins_per_band: int = 0

    @property
    def top(self) -> int:
        return self.budget if self.max_budget is None else self.max_budget

    def id(self) -> str:
        t = self.thresholds
        return _id("COMP", pid=self.policy_id, select=self.selection_method, budget=self.budget, maxK=self.top, lens=self.invariance_lens, recon=t.max_recon_rmse, energy=t.max_energy_residual, band=t.max_band_divergence, dc=self.include_dc, novelty=self.respect_novelty_boundary, numeric=self.numeric_policy)

    def merge_id(self) -> str:
        t = self.thresholds
        return _id("MERGECOMP", pid=self.policy_id, select=self.selection_method, budget=self.budget, maxK=self.top, lens=self.invariance_lens, recon=t.max_recon_rmse, energy=t.max_energy_residual, band=t.max_band_divergence, dc=self.include_dc)


@dataclass(frozen=True)
class Anomaly:
    policy_id: str = "unspecified"
    invariance_mode: str = "band_profile"
    divergence_metric: str = "band_l1"
    threshold_value: float = 0.15
    frequency_tolerance_hz: float = 0
    phase_sensitivity_mode: str = "strict"
    novelty_min_duration: float = 0
    segmentation_mode: str = "strict"
    dominant_bin_threshold: float = 0
    new_frequency_threshold: float = 0
    vanished_frequency_threshold: float = 0
    energy_shift_threshold: float = 0

    def id(self) -> str:
        return _id("ANOM", pid=self.policy_id, mode=self.invariance_mode, metric=self.divergence_metric, thresh=self.threshold_value, freqtol=self.frequency_tolerance_hz, phase=self.phase_sensitivity_mode, mindur=self.novelty_min_duration, seg=self.segmentation_mode, dominant=self.dominant_bin_threshold, new=self.new_frequency_threshold, vanish=self.vanished_frequency_threshold, eshift=self.energy_shift_threshold)


@dataclass(frozen=True)
class Merge:
    policy_id: str = "unspecified"
    adjacency_rule: str | None = "time_touching"
    phase_alignment_mode: str = "clock_delta_rotation"
    weights_mode: str = "duration"
    novelty_gate: str = "strict"
    merge_mode: str = "authoritative"
    grid_tolerance: float = 0

    def id(self) -> str:
        return _id("MERGE", pid=self.policy_id, adj=self.adjacency_rule or "unspecified", phase=self.phase_alignment_mode, weights=self.weights_mode, novelty=self.novelty_gate, mode=self.merge_mode, gridtol=self.grid_tolerance)


@dataclass(frozen=True)
class Replay:
    policy_id: str = "unspecified"
    output_format: str = "values"
    t0_override: float | None = None
    fill_missing_bins: str = "ZERO"
    validate_invariants: bool = False
    window_compensation: str = "NONE"
    numeric_policy: str = "tolerant"

    def id(self) -> str:
        return _id("RECON", pid=self.policy_id, format=self.output_format, t0="state" if self.t0_override is None else self.t0_override, missing=self.fill_missing_bins, validate=self.validate_invariants, window=self.window_compensation, numeric=self.numeric_policy)


@dataclass(frozen=True)
class Neighborhood:
    policy_id: str = "neighborhood.v1"
    similarity_threshold: float = 0.35
    min_member_count: int = 1
    weight_mode: str = "duration"
    linkage: str = "single_link"
    cross_segment: bool = False


@dataclass(frozen=True)
class Query:
    policy_id: str = "unspecified"
    scoring: str = "unspecified"
    normalization: str = "none"
    phase_used: bool = False
    allow_lens_merge: bool = False
    top: int = 10

    def id(self) -> str:
        return _id("QUERY", pid=self.policy_id, score=self.scoring, norm=self.normalization, phase=self.phase_used, lens=self.allow_lens_merge, topK=self.top)


@dataclass(frozen=True)
class Policies:
    """One run's policies."""

    ingest: Ingest = field(default_factory=Ingest)
    grid: Grid = field(default_factory=Grid)
    frame: Frame = field(default_factory=Frame)
    transform: Transform = field(default_factory=Transform)
    compression: Compression = field(default_factory=Compression)
    anomaly: Anomaly = field(default_factory=Anomaly)
    merge: Merge = field(default_factory=Merge)
    merged: Compression = field(default_factory=lambda: Compression(thresholds=Thresholds(0.30, 0.30, 0.30)))
    replay: Replay = field(default_factory=Replay)
    neighborhood: Neighborhood = field(default_factory=Neighborhood)
    clock_policy_id: str = "clock.v1"


def bench_policies(threshold: float = 0.15) -> Policies:
    """The settings of the published synthetic runs."""
    return Policies(
        ingest=Ingest("ingest.synthetic.v1"),
        grid=Grid(256.0, gap_policy="interpolate_small"),
        frame=Frame(256.0, 256, 128, overlap_ratio=0.5, gap_policy="interpolate_small", max_missing_ratio=0.25, boundary_policy="pad"),
        compression=Compression("compress.synthetic.v1", invariance_lens="identity"),
        anomaly=Anomaly("anomaly.synthetic.v1", threshold_value=threshold, frequency_tolerance_hz=1.0, dominant_bin_threshold=0.2, new_frequency_threshold=0.15, vanished_frequency_threshold=0.15, energy_shift_threshold=0.15),
        merge=Merge("merge.synthetic.v1"),
        merged=Compression("merge.compress.synthetic.v1", invariance_lens="identity", thresholds=Thresholds(0.30, 0.30, 0.30)),
        replay=Replay("reconstruct.synthetic.v1", validate_invariants=True),
        neighborhood=Neighborhood("basin.synthetic.v1"),
        clock_policy_id="clock.synthetic.v1",
    )


def as_map(policy) -> dict[str, str]:
    return {f.name: n(v) if not isinstance(v := getattr(policy, f.name), (tuple, Thresholds)) else str(v) for f in fields(policy)}
