"""Streams, workflow, files, reviews, and literal cases of single operators."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import language, receipts
from tidemark.operators import frames, graph, neighborhoods, novelty, posture, query, trajectory
from tidemark.plans import reviews, workflow
from tidemark.plans.policies import Anomaly, Frame, Query
from tidemark.sources import files, sampler
from tidemark.streaming import sampler as stream

# --- streaming


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(s, i, float(t), float(v)) for s in ("a", "b") for i, (t, v) in enumerate(zip(np.cumsum(rng.normal(1, 1.2, 90)), rng.normal(size=90), strict=True))]
    rows[5] = ("a", 5, float("nan"), 1.0)
    df = spark.createDataFrame(rows, "stream_id string, seq long, t double, v double")
    for k in range(3):
        df.where(f"seq >= {30 * k} and seq < {30 * k + 30}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.framed(live, 16, 8).writeStream.format("memory").queryName("framed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["stream_id"], r["w"]): (r["t0"], list(r["raw"])) for r in spark.table("framed").collect()}
    want = {}
    for s in ("a", "b"):
        kept = [(r["t"], r["v"]) for r in sampler.accepted(df).where(F.col("stream_id") == s).orderBy("seq").collect()]
        for w, begin in enumerate(range(0, len(kept) - 15, 8)):
            part = kept[begin : begin + 16]
            want[s, w] = part[0][0], [v for _, v in part]
    assert got == want and len(got) > 4


def test_commit_sink_is_idempotent(spark, tmp_path):
    batch = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "state_id string, w long")
    sink = stream.commit_batches(batch, str(tmp_path / "store"))
    sink(batch, 0)
    sink(batch, 0)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "store")).collect())) == [("x", 1), ("y", 2)]


def test_timeout_gives_the_rest_of_a_buffer():
    import pandas as pd

    class State:
        exists = hasTimedOut = False
        get = None
        timeout = None

        def update(self, x):
            self.exists, self.get = True, x

        def setTimeoutDuration(self, ms):
            self.timeout = ms

    state, run = State(), stream._accept(8, 4, 1000)
    first = list(run(("a",), iter([pd.DataFrame({"seq": range(10), "t": np.arange(10.0), "v": np.ones(10)})]), state))[0]
    assert first["w"].tolist() == [0] and state.timeout == 1000
    state.hasTimedOut = True
    rest = list(run(("a",), iter([]), state))[0]
    assert rest[["w", "t0", "size", "last"]].values.tolist() == [[1, 4.0, 6, True]]
    state.hasTimedOut = False
    late = list(run(("a",), iter([pd.DataFrame({"seq": range(9), "t": np.arange(9.0) + 5, "v": np.ones(9)})]), state))[0]
    assert late.empty and state.get[3] == [10.0, 11.0, 12.0, 13.0]


@pytest.mark.parametrize("mode", ["band_profile", "energy", "structural"])
def test_fold_goes_on_from_what_was_carried(spark, mode):
    """States in three tables, each going on from the one before, are segmented as in one; a state without a profile changes nothing."""
    rng = np.random.default_rng(2)
    rows = []
    for s in ("a", "b"):
        level = 0.0
        for w in range(30):
            level += rng.choice([0, 0, 0, 0.4])
            p = np.abs(np.sin(np.arange(4) + level)) + 0.02 * rng.random(4)
            bins = [(int(k), float(k), float(x), 0.0) for k, x in enumerate(p)]
            hole = w in (3, 11)
            rows.append((s, w, float(w), w + 2.0, None if hole else float(p.sum()), None if hole else (p / p.sum()).tolist(), None if hole else bins))
    df = spark.createDataFrame(rows, "stream_id string, w long, t_start double, t_end double, energy_raw double, profile array<double>, kept_bins array<struct<k:int,freq_hz:double,re:double,im:double>>")
    policy = Anomaly(invariance_mode=mode, divergence_metric={"structural": "l2_complex", "energy": "energy_delta"}.get(mode, "band_l1"), threshold_value=0.1)
    key = ["stream_id", "w", "epoch", "base_w", "novelty"]
    whole = sorted(map(tuple, novelty.segments(df, policy).select(*key).collect()), key=str)
    assert max(r[2] for r in whole) > 2 and all(r[3] is None and not r[4] for r in whole if r[1] in (3, 11))
    carried, parts = None, []
    for lo, hi in ((0, 9), (9, 10), (10, 30)):
        got = novelty.segments(df.where(f"w >= {lo} and w < {hi}"), policy, carried)
        parts += map(tuple, got.select(*key).collect())
        carried = spark.createDataFrame(novelty.baselines(got, policy, carried).collect(), novelty.baselines(got, policy, carried).schema)
    assert sorted(parts, key=str) == whole
    # the same divergence as the batch operator's
    b = df.alias("x")
    found = novelty.segments(df, policy).where("base_w is not null").select("stream_id", "w", "base_w", "divergence")
    base = df.select(F.col("stream_id").alias("s2"), F.col("w").alias("w2"), "energy_raw", "profile", "kept_bins")
    both = found.join(b, ["stream_id", "w"]).join(base.select("s2", "w2", F.struct("energy_raw", "profile", "kept_bins").alias("base")), (F.col("stream_id") == F.col("s2")) & (F.col("base_w") == F.col("w2")))
    match = novelty.align_bins(F.col("kept_bins"), F.col("base.kept_bins"), policy.frequency_tolerance_hz)
    d = novelty.divergence(policy, match["matched"], F.col("energy_raw"), F.col("base.energy_raw"), F.col("profile"), F.col("base.profile"))
    assert all(abs(r[0] - r[1]) < 1e-9 for r in both.select("divergence", d.alias("d")).collect())


def test_lane_is_the_batch_chain(spark, tmp_path):
    """A stream of samples in files, committed batch by batch, gives the states and segments of one batch; a batch run twice adds nothing."""
    from tidemark.plans.policies import Compression, Grid, Policies, Thresholds
    from tidemark.streaming import lane

    policies = Policies(grid=Grid(1.0), frame=Frame(1.0, 16, 8), compression=Compression("c", band_edges=(0.0, 0.1, 0.2, 0.5), thresholds=Thresholds(1e6, 0.9, 1.9)), anomaly=Anomaly(threshold_value=0.2))
    rng = np.random.default_rng(8)
    rows = [(s, i, float(i), float(np.sin(i * (0.4 if i < 60 else 1.3)) + 0.05 * rng.normal())) for s in ("a", "b") for i in range(128)]
    df = spark.createDataFrame(rows, "stream_id string, seq long, t double, v double")
    for k in range(4):
        df.where(f"seq >= {32 * k} and seq < {32 * k + 32}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store, sink, seen = str(tmp_path / "lane"), lane.lane(policies, str(tmp_path / "lane")), []

    def twice(batch, batch_id):
        sink(batch, batch_id)
        seen.append(batch_id)
        if batch_id == 1:
            sink(batch, batch_id)

    stream.framed(live, 16, 8).writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(300)
    got = lane.read(spark, store, "states")
    frames_ = [(s, w, float(8 * w), 16, [v for _, i, _, v in rows if _ == s and 8 * w <= i < 8 * w + 16]) for s in ("a", "b") for w in range(15)]
    frames_ = [(s, w, t, n, [r[3] for r in rows if r[0] == s and 8 * w <= r[1] < 8 * w + 16]) for s, w, t, n, _ in frames_]
    whole = novelty.segments(lane.states_of_frames(spark.createDataFrame(frames_, "stream_id string, w long, t0 double, size int, raw array<double>"), policies), policies.anomaly)
    key = ["stream_id", "w", "segment_id", "novelty", F.round("energy_raw", 9)]
    assert len(seen) > 2 and got.count() == 30
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, whole.select(*key).collect()))
    assert got.select("segment_id").distinct().count() > 2 and lane.read(spark, store, "refused").count() == 0


# --- sources


def test_sampler_faults(spark):
    rows = spark.createDataFrame([("s", "m", 1.0), ("", "m", 0.0), (None, " ", float("nan"))], "a string, b string, c double")
    got = [r[0] for r in rows.select(sampler.config_faults(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert [len(x) for x in got] == [0, 2, 3]
    some = spark.createDataFrame([("x", i, float(i), float(i * i)) for i in range(10)], "stream_id string, seq long, t double, v double")
    assert sampler.flush(some).count() == 10 and sampler.flush(some, 4).count() == 4
    for code, call in (("BUFFER_EMPTY", lambda: sampler.flush(some.limit(0))), ("EMPTY_IMPORT", lambda: sampler.imported(some.limit(0))), ("INVALID_CONFIG", lambda: sampler.rms_envelope(some, 0, 1.0))):
        with pytest.raises(sampler.SamplerError, match=code):
            call()
    assert [r["t"] for r in sampler.imported(some.drop("t"), 2.0, 5.0).orderBy("seq").limit(3).collect()] == [5.0, 5.5, 6.0]
    one = sampler.described(some, "src", "sound", 8.0, clock_policy_id="c").first()
    assert one["values"] == [float(i * i) for i in range(10)] and one["source"]["Fs_nominal"] == 8.0 and one["faults"] == []


def test_live_cycles(spark, tmp_path):
    from tidemark.plans import live, policies, session

    with pytest.raises(ValueError, match="unsupported source mode"):
        live.source(spark, "radio")
    one = session.Session(spark, policies.bench_policies())
    rows = list(live.cycles(one, live.source(spark, "sampler_flush_chunk", chunk=1024), str(tmp_path / "live"), str(tmp_path / "receipts"), number=3, keep=2, mode="sampler_flush_chunk"))
    assert [r["cycle_index"] for r in rows] == [1, 2, 3] and rows[0]["state_count_changed"] == "n/a" and rows[1]["state_count_changed"] in ("changed", "no_change")
    assert sorted(p.name for p in (tmp_path / "live").iterdir()) == ["cycle_02", "cycle_03"]
    assert [c for c, _ in files.list_receipts(spark, str(tmp_path / "receipts"))] == [2, 3]
    assert (tmp_path / "live/cycle_03/summary.txt").read_text() == rows[2]["text"] and "Cycle 3" in rows[2]["text"]
    assert spark.read.json(str(tmp_path / "live/cycle_03/workbench")).count() == 1


def test_published_cases_as_bundles(spark, tmp_path):
    from tidemark.plans import live

    rows = live.workbench(spark, str(tmp_path / "bench"), ("clean",)).collect()
    assert [(r["case_name"], r["state_count"], r["segment_transition_count"]) for r in rows] == [("clean", 28, 0)]
    assert files.bundles(spark, str(tmp_path / "bench")) == [("clean", str(tmp_path / "bench/clean/workbench.json"))]
    assert json.loads((tmp_path / "bench/clean/workbench.json").read_text())["summary"]["state_count"] == 28


def test_scales(spark):
    from tidemark.functions import probes

    rows = spark.createDataFrame([(1, 0.1, True), (1, 0.3, False), (1, 0.2, True), (2, 0.5, True), (2, 0.4, False), (2, 0.1, False), (3, 0.2, True)], "scale int, value double, similar boolean")
    got = {r["scale"]: (round(r["threshold"], 9), r["clean_gap"]) for r in probes.scale_thresholds(rows).collect()}
    assert got == {1: (0.25, True), 2: (0.4, False), 3: (0.6, True)}
    cases = spark.createDataFrame([(0.0, 0.0, "flat", 3), (1.0, 0.01, "flat", 3), (1.0, 0.1, "flat", 3), (0.5, 0.0, "up", 3), (1.0, 0.0, "flat", 1)], "c double, s double, d string, n int")
    assert [r[0] for r in cases.select(probes.scale_behaviour(F.col("c"), F.col("s"), F.col("d"), F.col("n"))).collect()] == ["collapse", "persistence", "lawful_transformation", "fragmentation_consolidation", "insufficient_scales"]


def test_prompts(spark, tmp_path):
    view = {"scope": {"stream_id": "s"}, "x": [1]}
    text = reviews.prompt(view, "answer")
    assert text.splitlines()[1] == reviews.INSTRUCTIONS[0] and text.endswith(json.dumps(view, indent=2))
    body = text.split("matching this template:\n")[1].split("\n\nLM input")[0]
    assert json.loads(body) == reviews.template("answer", "s") and json.loads(body)["authority_posture"] == language.POSTURE
    paths = reviews.stage(spark, view, str(tmp_path / "stage"), "answer")
    assert json.loads((tmp_path / "stage/lm_input.json").read_text()) == view and (tmp_path / "stage/lm_prompt.txt").read_text() == text + "\n" and "lm_output" in paths


def test_bundles_and_stamps(spark, tmp_path):
    for case in ("b", "a", "empty"):
        (tmp_path / "w" / case).mkdir(parents=True)
    for at in ("workbench.json", "a/workbench.json", "b/workbench.json"):
        (tmp_path / "w" / at).write_text("{}")
    root = str(tmp_path / "w")
    assert [c for c, _ in files.bundles(spark, root)] == ["a", "b", "default"] and [c for c, _ in files.bundles(spark, root, {"b", "x"})] == ["b"]
    assert files.bundles(spark, str(tmp_path / "none")) == []
    assert spark.sql("select timestamp '2024-03-05 06:07:08.009' as t").select(files.run_stamp(F.col("t"))).first()[0] == "2024-03-05T06-07-08-009Z"


def test_summary_text(spark):
    from tidemark.operators import digest

    df = spark.createDataFrame([(3, "r", None, 5)], "cycle_index int, run_label string, convergence string, state_count int")
    text = df.select(digest.summary_text(df.columns)).first()[0]
    assert text.startswith("\nCycle 3\n  run_label: r\n  stream_id: -\n") and "    states=5  basins=0  segments=0  skipped=0  merge_failures=0\n" in text and "    convergence=-\n" in text and text.endswith("cross_run_count=0\n")


def test_formats(spark, tmp_path):
    from tidemark.functions import schemas

    entry = {"pass_id": "p", "role": "r", "active_subject_id": "s", "state_before": "a", "state_after": "b", "accepted_changes": [], "rejected_changes": ["x"], "live_tensions": [], "recommended_next_role": "q"}
    response = entry | {"mutated_live_surface": True, "write_payload_notes": [], "cycle_log_entry": entry, "recommended_next_state": "z"}
    output = {"response_type": "t", "input_stream_id": None, "observations": ["o"], "questions": [], "non_claims": ["n"], "authority_posture": language.POSTURE}
    report = {"probe_type": "x", "per_cohort_rows": [1, 2], "replay_summary": {"not_canon": True}, "disclaimers": {}, "comparisons": [1]}
    cases = [
        ("cycle_log_entry", entry, []),
        ("cycle_log_entry", entry | {"accepted_changes": [""], "role": 1, "more": 0}, ["role", "accepted_changes", "more"]),
        ("cycle_log_entry", {}, list(entry)),
        ("role_response", response, []),
        ("role_response", response | {"cycle_log_entry": entry | {"x": 1, "role": ""}, "live_surface_patch": {"any": 1}}, ["cycle_log_entry.role", "cycle_log_entry.x"]),
        ("role_response", response | {"cycle_log_entry": None, "live_surface_patch": 3}, ["live_surface_patch", "cycle_log_entry"]),
        ("model_output", output, []),
        ("model_output", output | {"non_claims": [], "authority_posture": language.POSTURE | {"truth_closure": "false"}}, ["non_claims", "authority_posture.truth_closure"]),
        ("orchestrator_receipt", {"receipt_type": "t", "stream_id": "s", "source_id": None, "query_present": False} | {k: 1 for k in ("state_count", "basin_count", "segment_count", "trajectory_frames", "segment_transition_count", "h1_count", "m1_count", "anomaly_count", "skipped_window_count")} | {"merge_failure_count": 1.5, "free": 1}, ["merge_failure_count"]),
    ]
    for name, document, want in cases:
        df = spark.createDataFrame([(json.dumps(document),)], "d string")
        assert df.select(schemas.broken(F.col("d"), name, **({"response_type": "t"} if name == "model_output" else {"receipt_type": "t"} if "receipt" in name else {}))).first()[0] == want, name
    odd = spark.createDataFrame([("[1]",), ("{",), (None,)], "d string").select(schemas.broken(F.col("d"), "cycle_log_entry")).collect()
    assert [r[0] for r in odd] == [["$"]] * 3
    made = spark.createDataFrame([(json.dumps(report),), ("{}",)], "d string").select(schemas.probe_receipt(F.col("d")).alias("r")).select(F.to_json("r", {"ignoreNullFields": "false"}).alias("r"))
    first, second = [json.loads(r[0]) for r in made.collect()]
    assert first["row_surface"] == {"path": "per_cohort_rows", "row_count": 2} and first["summary_surface"] == {"path": "replay_summary", "available": True} and first["counts"] == {"comparison_count": 1, "family_summary_count": 0}
    assert first["posture_flags"] == {"has_constitutional_posture": False, "has_disclaimers": True, "not_canon_evidence": True, "not_prediction_evidence": False}
    assert second["probe_type"] == "unknown_probe_report" and second["row_surface"]["path"] == second["summary_surface"]["path"] == "none"
    assert made.select(schemas.broken(F.col("r"), "probe_receipt", receipt_type="runtime:probe_report_receipt", receipt_version="0.1.0").alias("b")).where("size(b) > 0").count() == 0
    with pytest.raises(ValueError, match="needs a value"):
        schemas.broken(F.col("d"), "model_output")
    kinds = {"receipt_type": "runtime:probe_report_receipt", "receipt_version": "0.1.0"}
    path = str(tmp_path / "receipt.json")
    assert files.write_checked(spark, path, first, "probe_receipt", **kinds) == first
    assert files.read_checked(spark, path, "probe_receipt", **kinds) == (first, [])
    with pytest.raises(ValueError, match="INVALID_PROBE_RECEIPT: probe_type"):
        files.write_checked(spark, path, first | {"probe_type": ""}, "probe_receipt", **kinds)



def test_receipt_files(spark, tmp_path):
    root = str(tmp_path / "receipts")
    assert files.list_receipts(spark, root) == [] and files.read_receipts(spark, root) is None
    for i in (10, 2, 1):
        files.write_receipt(spark, root, {"cycle_index": i, "run_label": f"run {i}/a", "state_count": i})
    (tmp_path / "receipts" / "other.json").write_text("{}")
    assert [c for c, _ in files.list_receipts(spark, root)] == [1, 2, 10]
    rows = files.read_receipts(spark, root).orderBy("file_cycle").collect()
    assert [(r["file_name"], r["state_count"]) for r in rows][0] == ("receipt_cycle_0001_run_1_a.json", 1)
    assert len(files.prune(spark, root, 1)) == 2 and [c for c, _ in files.list_receipts(spark, root)] == [10]


def test_bundle(spark):
    one = spark.createDataFrame([("s", 3)], "stream_id string, state_count long")
    doc = files.bundle(one, states=spark.createDataFrame([("s", 2), ("s", 1)], "stream_id string, w long")).first()["document"]
    assert json.loads(doc) == {"summary": {"stream_id": "s", "state_count": 3}, "states": [{"w": 1}, {"w": 2}]}


# --- frames and trajectory


@pytest.mark.parametrize(("size", "windows"), [(8, 255), (16, 127), (32, 63), (64, 31)])
def test_window_counts(spark, size, windows):
    aligned = spark.range(1024).select(F.lit("s").alias("stream_id"), F.col("id").alias("i"), (F.col("id") / 256).alias("tq"), F.sin(F.col("id") / 3).alias("v"))
    assert frames.frames(aligned, Frame(256.0, size, size // 2)).count() == windows


def _path(spark, basins, ends=None):
    rows = [("s", i, float(i), float(i) + (ends or {}).get(i, 1), "g0", b) for i, b in enumerate(basins)]
    return spark.createDataFrame(rows, "stream_id string, frame_index long, t_start double, t_end double, segment_id string, basin_id string")


@pytest.mark.parametrize(
    ("basins", "moves", "again"),
    [("AAA", 0, {"A": 0}), ("A-A", 0, {"A": 1}), ("ABA", 2, {"A": 1, "B": 0}), ("A-B", 0, {"A": 0, "B": 0}), ("ABBC", 2, {"A": 0, "B": 0, "C": 0}), ("ABABA", 4, {"A": 2, "B": 1})],
)
def test_sequences(spark, basins, moves, again):
    path = _path(spark, [None if b == "-" else b for b in basins])
    assert trajectory.transitions(path).count() == moves
    assert {r["basin_id"]: r["re_entry_count"] for r in trajectory.recurrence(path).collect()} == again


def test_current_dwell(spark):
    assert trajectory.current(_path(spark, ["A", "A", "A"])).first()[2:] == (3, 3.0)
    assert trajectory.current(_path(spark, ["A", "A", "B"], {2: 2})).first()[2:] == (1, 2.0)
    assert trajectory.current(_path(spark, ["A", None])).first()[1:] == (None, 0, 0.0)


def test_convergence_slope(spark):
    path = _path(spark, ["A"] * 3).withColumn("distance", F.when(F.col("frame_index") == 0, 0.5).when(F.col("frame_index") == 1, 0.3).otherwise(0.1))
    row = trajectory.convergence(path).first()
    assert row["is_converging"] and row["trend_slope"] == pytest.approx(-0.2)


# --- clusters and graph


def _nodes(spark, profiles):
    return spark.createDataFrame([("g", i, p) for i, p in enumerate(profiles)], "segment_id string, node long, profile array<double>")


def test_two_groups(spark):
    nodes = _nodes(spark, [[1.0, 0.0], [0.95, 0.05], [0.97, 0.03], [0.05, 0.95], [0.02, 0.98]])
    for link in (neighborhoods.single_link, neighborhoods.complete_link):
        labels = {r["node"]: r["label"] for r in link(nodes, 0.3).collect()}
        assert labels == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    chain = _nodes(spark, [[i / 10, 1 - i / 10] for i in range(6)])
    assert {r["label"] for r in neighborhoods.single_link(chain, 0.25).collect()} == {0}
    assert len({r["label"] for r in neighborhoods.complete_link(chain, 0.25).collect()}) == 3


GRAPH = [("a", "A", "g0", [1.0, 0.0], 1.00, []), ("b", "A", "g0", [0.8, 0.2], 1.08, []), ("c", "A", "g0", [0.6, 0.4], 1.80, []), ("d", "A", "g1", [0.3, 0.7], 1.10, []), ("e", "B", "g0", [0.45, 0.55], 1.05, []), ("m", "A", "g0", [0.9, 0.1], 0.97, ["b", "d"])]


def test_graph_corpus(spark):
    rows = [(i, s, t, g, "M1" if m else "H1", p, e, m) for i, (s, t, g, p, e, m) in enumerate(GRAPH)]
    states = spark.createDataFrame(rows, "commit_idx long, state_id string, stream_id string, segment_id string, artifact_class string, profile array<double>, energy_raw double, merged_from array<string>").withColumns({"t_start": F.col("commit_idx").cast("double"), "t_end": F.col("commit_idx") + 1.0})
    edges = graph.edges(states).collect()
    kinds = {k: sum(e["edge_type"] == k for e in edges) for k in ("payload_ref", "temporal_next", "merge_lineage_ref")}
    assert kinds == {"payload_ref": 6, "temporal_next": 4, "merge_lineage_ref": 2}
    assert graph.ledger(states).count() == 6
    assert [r["state_id"] for r in graph.state_view(states)[0].orderBy("commit_idx").collect()] == ["b", "c", "d", "e", "m"]
    pairs = {(r["from"], r["to"]) for r in graph.similarity_edges(states).collect()}
    assert ("MO:c", "MO:e") in pairs and ("MO:a", "MO:d") not in pairs
    close = graph.similarity_edges(states, graph.Similarity(amplitude_threshold=0.10))
    assert ("MO:d", "MO:e") in {(r["from"], r["to"]) for r in close.collect()} and ("MO:c", "MO:e") not in {(r["from"], r["to"]) for r in close.collect()}
    assert graph.similarity_edges(states, known=graph.similarity_edges(states)).count() == 0
    assert graph.commit(states.unionByName(states), states).count() == 0
    assert graph.lookup(graph.objects(states), "MO:a").count() == graph.lookup(graph.objects(states), "a").count() == 1


# --- novelty and queries


def _state(spark, name, energy, bins, stream="s"):
    return spark.createDataFrame([(name, stream, "g", 0.0, 1.0, 8.0, 8, 1.0, energy, [0.5, 0.5], bins, "H1")], "state_id string, stream_id string, segment_id string, t_start double, t_end double, rate double, size int, df double, energy_raw double, profile array<double>, kept_bins array<struct<k:int,freq_hz:double,re:double,im:double,magnitude:double,phase:double>>, artifact_class string")


def _pair(spark, a, b):
    return a.select(F.struct(*a.columns).alias("current")).join(b.select(F.struct(*b.columns).alias("base")))


BIN = [(1, 1.0, 1.0, 0.0, 1.0, 0.0)]


def test_energy_mode(spark):
    row = novelty.compare(_pair(spark, _state(spark, "x", 100.0, BIN), _state(spark, "y", 1.0, BIN)), Anomaly(invariance_mode="energy", divergence_metric="energy_delta")).first()
    assert row["divergence_score"] == 99.0 and row["novelty_gate_triggered"] and row["error"] is None
    assert novelty.compare(_pair(spark, _state(spark, "x", 1.0, BIN), _state(spark, "y", 1.0, BIN, "other"))).first()["error"] == "BASELINE_SCOPE_MISMATCH"


def test_tolerant_matching_is_greedy(spark):
    b = lambda *ks: [(k, float(k), 1.0, 0.0, 1.0, 0.0) for k in ks]
    rows = _pair(spark, _state(spark, "x", 1.0, b(1, 4)), _state(spark, "y", 1.0, b(2, 3, 9)))
    found = rows.select(novelty.align_bins(F.col("current.kept_bins"), F.col("base.kept_bins"), 1.0).alias("m")).first()["m"]
    assert [(p["current"]["k"], p["base"]["k"]) for p in found["matched"]] == [(1, 2), (4, 3)]
    assert [x["k"] for x in found["base_only"]] == [9] and found["current_only"] == []


def test_query_errors(spark):
    both = _state(spark, "x", 1.0, BIN).unionByName(_state(spark, "y", 1.0, BIN).withColumn("segment_id", F.lit("h")))
    with pytest.raises(query.QueryError, match="INVALID_SCOPE"):
        query.energy_trend(both, query.Scope())
    with pytest.raises(query.QueryError, match="INVALID_BAND_SPEC"):
        query.band_lookup(both, "x:1", query.Scope(allow_cross_segment=True), Query())
    with pytest.raises(query.QueryError, match="UNSUPPORTED"):
        query.envelope(both, "other", "ENERGY", query.Scope(), Query())
    assert query.compare(both, "x", "nowhere", query.Scope(allow_cross_segment=True), "ENERGY", Query(), check=False).count() == 0
    with pytest.raises(query.QueryError, match="REF_NOT_FOUND"):
        query.compare(both, "x", "nowhere", query.Scope(allow_cross_segment=True), "ENERGY", Query())
    with pytest.raises(query.QueryError, match="INVALID_QUERY"):
        query.compare(both, "x", "", query.Scope(allow_cross_segment=True), "ENERGY", Query())
    with pytest.raises(query.QueryError, match="INVALID_QUERY"):
        query.similarity(both, None, query.Scope(allow_cross_segment=True), "ENERGY", Query())
    with pytest.raises(query.QueryError, match="EMPTY_CORPUS"):
        query.corpus(both, stream_id="nobody")
    with pytest.raises(query.QueryError, match="valid segment_id"):
        query.checked(both.withColumn("segment_id", F.lit("")))


def test_replay_tiers(spark):
    base = {"request_status": "prepared", "replay_type": "runtime_reconstruction", "target_type": "state", "target_ref": "r", "target_request_type": "q", "run_ok": True, "has_bundle": True, "has_runtime_support": True, "receipt_refs": ["a"], "provenance_complete": True, "replayable_support": True}
    cases = [({"tier": 0}, "supported"), ({"tier": 1}, "supported"), ({"tier": 2}, "insufficient"), ({"tier": 4}, "insufficient"), ({"tier": 0, "run_ok": False}, "failed"), ({"tier": 1, "receipt_refs": []}, "failed"), ({"tier": 0, "replay_type": "request_support_replay", "target_ref": None}, "degraded"), ({"tier": 0, "has_bundle": None}, "unresolved")]
    schema = "id int, tier int, request_status string, replay_type string, target_type string, target_ref string, target_request_type string, run_ok boolean, has_bundle boolean, has_runtime_support boolean, receipt_refs array<string>, provenance_complete boolean, replayable_support boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    rows = [tuple({"id": i, "tier": 0, **base, **c}[n] for n in names) for i, (c, _) in enumerate(cases)]
    got = posture.trace(posture.evaluate(spark.createDataFrame(rows, schema))).orderBy("id").collect()
    assert [r["threshold_class"] for r in got] == [want for _, want in cases]
    assert got[0]["trace"][-1]["step_type"] == "reconstruction_completed" and got[4]["trace"][-1]["status"] == "failed"
    assert got[0]["fidelity_class"] == "bounded_support_trace"


# --- text and receipts


def test_find_object_against_the_json_parser():
    """Objects of the json module in any text without braces are found whole."""
    import random

    rng = random.Random(3)

    def value(depth: int):
        kind = rng.randrange(5 if depth < 3 else 3)
        if kind < 3:
            return rng.choice([1, None, True, 'a"b', "{", "}}", "\\\\", 'x\\\\"{', "é\n"])
        return [value(depth + 1) for _ in range(3)] if kind == 3 else {rng.choice('ab{}"') + str(i): value(depth + 1) for i in range(rng.randrange(4))}

    for _ in range(300):
        text, before, after = json.dumps({"k": value(0)}, ensure_ascii=False), rng.choice(["", "say ", 'a "quoted" word: ']), rng.choice(["", " done", " }"])
        assert language.find_object(before + text + after) == (text, before, after)
        assert language.find_object(before + text[:-1])[0] is None


def test_find_object():
    assert language.find_object('say {"a": "}", "b": {"c": 1}} done') == ('{"a": "}", "b": {"c": 1}}', "say ", " done")
    assert language.find_object('{"a": "\\"}"}')[0] == '{"a": "\\"}"}'
    assert language.find_object("none")[0] is None and language.find_object("{open")[0] is None and language.find_object(None) == (None, "", "")


def test_schema_subset():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "array", "minItems": 1, "items": {"$ref": "#/definitions/x"}}, "k": {"const": 1}}, "definitions": {"x": {"type": ["integer", "null"], "minimum": 2}}}
    assert receipts.validate({"a": [2, None]}, schema) == []
    assert len(receipts.validate({"a": [1, "x", True], "k": 2, "z": 0}, schema)) == 5
    assert receipts.validate({}, schema) == ["$.a is required"]


SCHEMA = {"type": "object", "required": ["response_type", "observations"]}


def test_review_receipts(spark):
    good = {"response_type": "review", "observations": ["x", " "], "questions": ["Q?", "q? "], "non_claims": language.REQUIRED_NON_CLAIMS, "authority_posture": language.POSTURE}
    answers = iter([json.dumps(good), f"see: {json.dumps(good)}", "nothing"])
    rows = reviews.benchmark(spark, "prompt", lambda _: next(answers), SCHEMA, "review")
    got = rows.orderBy("run_index").collect()
    assert [r["passed"] for r in got] == [True, False, False] and got[0]["duplicate_question_count"] == 1 and got[0]["empty_observation_count"] == 1
    assert got[2]["authority_drift_count"] == 7 and not got[1]["no_extra_text"]
    assert reviews.summary(rows).first()[:4] == (3, 1, 2, 1)
    drift = spark.createDataFrame([(json.dumps(language.POSTURE),), ('{"read_side_only": false}',), ("x",), (None,)], "p string").select(language.authority_drift(F.col("p")).alias("d"))
    assert [r["d"] for r in drift.collect()] == [0, 7, 7, 7]


# --- workflow

SUBJECT = {"subject_id": "s1", "state": "seeded", "live_surface_path": "surface.md", "section_anchor": "Draft", "forbidden_write_zones": []}
SURFACE = "# Title\n\n## Draft\n\nold\n\n### Sub\nx\n\n## Rest\n\nkeep\n"


def _answer(request, after, **more):
    return {"pass_id": request["pass_id"], "role": request["role"], "active_subject_id": "s1", "state_before": request["state_before"], "state_after": after} | more


def test_workflow_to_the_end(tmp_path):
    w = workflow.Workflow.create(tmp_path, SUBJECT, SURFACE)
    for after, more in (("compressed", {"new_text": "new"}), ("gate_pending", {}), ("metastable_hold", {})):
        request = w.dispatch()
        w.respond(_answer(request, after, **more))
        w.consume()
    assert w.checkpoint["status"] == "completed" and [x["role"] for x in w.log()] == ["constructor", "reflector", "auditor_gate"]
    assert (tmp_path / "surface.md").read_text() == "# Title\n\n## Draft\nnew\n## Rest\n\nkeep\n"
    with pytest.raises(workflow.WorkflowError, match="RUNNER_COMPLETED"):
        w.dispatch()


@pytest.mark.parametrize(("change", "code"), [({"state_after": "released"}, "ILLEGAL_STATE_TRANSITION"), ({"pass_id": "x"}, "PASS_ID_MISMATCH"), ({"active_subject_id": "x"}, "SUBJECT_MISMATCH"), ({"role": "reflector"}, "UNEXPECTED_ROLE_RESPONSE"), ({"recommended_next_role": "creative"}, "ILLEGAL_NEXT_ROLE"), ({"state_after": None}, "INVALID_RESPONSE_SCHEMA")])
def test_workflow_halts(tmp_path, change, code):
    w = workflow.Workflow.create(tmp_path, SUBJECT, SURFACE)
    request = w.dispatch()
    with pytest.raises(workflow.WorkflowError, match=code):
        w.respond(_answer(request, "compressed") | change)
        w.consume()
    assert w.checkpoint["status"] == "halted"
    with pytest.raises(workflow.WorkflowError, match="RUNNER_HALTED"):
        w.resume()


def test_workflow_paths_and_pauses(tmp_path):
    with pytest.raises(workflow.WorkflowError, match="FORBIDDEN_WRITE_ZONE"):
        workflow.Workflow.create(tmp_path, SUBJECT | {"live_surface_path": "../x.md"}, SURFACE)
    w = workflow.Workflow.create(tmp_path, SUBJECT, SURFACE)
    w.interrupt("pause")
    with pytest.raises(workflow.WorkflowError, match="RUNNER_INTERRUPTED"):
        w.dispatch()
    w.resume()
    w.dispatch()
    with pytest.raises(workflow.WorkflowError, match="MISSING_RESPONSE"):
        w.consume()
