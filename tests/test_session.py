from __future__ import annotations

import json

import pytest

from tidemark.plans.policies import bench_policies
from tidemark.plans.session import Session
from tidemark.sources import signals


def test_session(spark):
    session = Session(spark, bench_policies())
    samples = signals.samples_of(spark, "s", *signals.synthetic("baseline", 42, 0.03))
    session.ingest(samples, "a")
    session.ingest(samples, "b")
    with pytest.raises(ValueError, match="taken"):
        session.ingest(samples, "a")
    rows = {r["run_label"]: r for r in session.signatures.collect()}
    assert (rows["a"]["state_count"], rows["a"]["anomaly_count"], rows["a"]["novelty_gate_count"], rows["a"]["basin_count"]) == (23, 12, 4, 5)
    pairs, overall = session.compare()
    pair, all_runs = pairs.first(), overall.first()
    assert pair["similarity_ratio"] == 1.0 and pair["similarity"] == "high"
    assert all_runs["overall_reproducibility"] == "high" and "high_pairwise_agreement" in all_runs["dynamics_flags"]
    changes = session.cycles().orderBy("cycle_index").collect()
    assert [c["state_count_changed"] for c in changes] == ["n/a", "no_change"] and changes[0]["convergence"] == "novelty_observed"
    document = json.loads(session.bundle().first()["document"])
    assert document["summary"]["h1_count"] == 16 and len(document["transitions"]) == 4
    session.clear()
    with pytest.raises(ValueError, match="no run"):
        session.compare()
