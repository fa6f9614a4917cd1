"""The published synthetic runs: counts of all tables, and when segments change."""

from __future__ import annotations

import pytest

from tidemark.operators.components import written
from tidemark.plans import pipeline, policies
from tidemark.sources import signals

COUNTS = ("state_count", "h1_count", "m1_count", "basin_count", "segment_count", "segment_transition_count", "anomaly_count", "skipped_window_count", "merge_failure_count")
CASES = {
    "baseline": (42, 0.03, 0.15, (23, 16, 7, 5, 4, 4, 12, 1, 1), [2.5, 4.5, 8.0, 9.0]),
    "rough": (123, 0.08, 0.08, (22, 15, 7, 8, 5, 5, 10, 2, 0), [1.5, 4.0, 7.0, 8.0, 9.0]),
    "clean": (42, 0.01, 0.20, (28, 19, 9, 1, 1, 0, 18, 0, 0), []),
}


@pytest.mark.parametrize("profile", CASES)
def test_published_counts(spark, profile):
    seed, noise, threshold, counts, changes = CASES[profile]
    samples = signals.samples_of(spark, "s", *signals.synthetic(profile, seed, noise))
    found = pipeline.run(samples, policies.bench_policies(threshold), written)
    row = found.summary.first()
    assert tuple(row[c] for c in COUNTS) == counts
    assert [r["t_transition"] for r in found.transitions.orderBy("t_transition").collect()] == changes
    assert found.trajectory.count() == counts[0]


def test_streams_are_independent(spark):
    a = signals.samples_of(spark, "a", *signals.synthetic("baseline", 42, 0.03))
    b = signals.samples_of(spark, "b", *signals.synthetic("rough", 123, 0.08))
    states = pipeline.states_of(a.unionByName(b), policies.bench_policies())[2]
    alone = pipeline.states_of(a, policies.bench_policies())[2]
    key = ["stream_id", "w", "energy_raw"]
    assert sorted(map(tuple, states.where("stream_id = 'a'").select(key).collect())) == sorted(map(tuple, alone.select(key).collect()))
