"""Checks of JSON receipts, handoffs and model documents against their named formats, as columns.

A document is parsed once to a VARIANT; a rule looks at one path.  The result
names the paths that break their rule, in the format's order; below a path that
should be an object and isn't, nothing more is named.  Closed formats also name
keys that they don't know.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rules of a path: ``object``, ``text``, ``name`` (text that isn't empty), ``flag``, ``count`` (whole number from 0),
#: ``index`` (from 1), ``size`` (number from 0), ``names`` (list of names), ``some names`` (one at least), ``list``,
#: ``yes``, ``no``, ``const`` (a value that the caller gives), ``a|b`` (one of these); ``?`` allows null, ``+`` absence too.
#: The formats' paths are fixed values.
FORMATS: dict[str, str] = {
    "orchestrator_receipt": """
        receipt_type const; stream_id text?; source_id text?; state_count count; basin_count count; segment_count count;
        trajectory_frames count; segment_transition_count count; h1_count count; m1_count count; anomaly_count count;
        skipped_window_count count; merge_failure_count count; query_present flag""",
    "workbench_receipt": """
        receipt_type const; stream_id text?; source_id text?; segment_count count; state_count count; basin_count count;
        query_present flag; cross_run_available flag; cross_run_run_count count""",
    "provenance_receipt": """
        receipt_type const; receipt_version const; generated_from name; written_at name;
        cycle object; cycle.cycle_dir name; cycle.cycle_index count?; cycle.run_label text?;
        scope object; scope.stream_id text?; scope.source_mode text?; scope.source_id text?; scope.channel text?; scope.modality text?;
        structural_summary object; structural_summary.state_count count; structural_summary.basin_count count; structural_summary.segment_count count;
        structural_summary.convergence name; structural_summary.motion name; structural_summary.occupancy name; structural_summary.recurrence name; structural_summary.continuity name;
        cross_run_context object; cross_run_context.available flag; cross_run_context.run_count count;
        references object; references.live_cycle_dir name; references.latest_workbench name; references.latest_run_result name; references.latest_cross_run_report name; references.latest_session_summary name""",
    "reconstruction_receipt": """
        receipt_type const; replay_request_id text?; replay_type name; reconstruction_status completed|downgraded|failed|unknown; target_type text?;
        retained_tier name; support_basis_count count; runtime_support_available flag; receipt_support_available flag;
        threshold_outcome text?; downgrade_output text?; mechanization_status mechanized|partially_mechanized|failed|unknown""",
    "probe_receipt": """
        receipt_type const; receipt_version const; probe_type name; row_surface object; row_surface.path name; row_surface.row_count count;
        summary_surface object; summary_surface.path name; summary_surface.available flag;
        posture_flags object; posture_flags.has_constitutional_posture flag; posture_flags.has_disclaimers flag; posture_flags.not_canon_evidence flag; posture_flags.not_prediction_evidence flag;
        authority_posture object; authority_posture.advisory_only yes; authority_posture.read_side_only yes; authority_posture.runtime_authority no; authority_posture.canon_authority no;
        counts object; counts.comparison_count count; counts.family_summary_count count; report_ref object; report_ref.report_path text?""",
    "pass_request": """
        closed; pass_id name; role constructor|creative|reflector|auditor_gate|admin_router; active_subject_id name; state_before name; purpose name;
        scope object; scope.live_surface_path name; scope.section_anchor name; scope.forbidden names; inputs object; inputs.* any; required_output_keys some names""",
    "role_response": """
        closed; pass_id name; role name; active_subject_id name; state_before name; state_after name; mutated_live_surface flag; live_surface_patch object+;
        live_surface_patch.* any; accepted_changes names; rejected_changes names; live_tensions names; write_payload_notes names; cycle_log_entry object;
        cycle_log_entry.pass_id name; cycle_log_entry.role name; cycle_log_entry.active_subject_id name; cycle_log_entry.state_before name; cycle_log_entry.state_after name;
        cycle_log_entry.accepted_changes names; cycle_log_entry.rejected_changes names; cycle_log_entry.live_tensions names; cycle_log_entry.recommended_next_role name;
        recommended_next_role name; recommended_next_state name""",
    "gate_decision": """
        closed; pass_id name; role auditor_gate; active_subject_id name; structural_gain_judgment name; decision hold|release|compress_upward|rebound|defer;
        next_layer name; next_active_subject_id name; reason name; state_transition object; state_transition.from name; state_transition.to name;
        subject_register_update object+; subject_register_update.* any""",
    "cycle_log_entry": """
        closed; pass_id name; role name; active_subject_id name; state_before name; state_after name; accepted_changes names; rejected_changes names;
        live_tensions names; recommended_next_role name""",
    "subject_register_entry": """
        closed; subject_id name; title name; layer name; state name; parent_subject_id text?; eligible_next_subjects names; release_criteria names;
        known_tensions names; last_role name; recommended_next_role name; notes text+""",
    "model_input": """
        closed; input_type const; workbench_type const; scope object; scope.stream_id text?; scope.source_id text?; scope.segment_ids names;
        scope.cross_run_available flag; scope.run_count count; runtime_receipt object; runtime_receipt.state_count count; runtime_receipt.basin_count count;
        runtime_receipt.segment_count count; runtime_receipt.trajectory_frames count; runtime_receipt.segment_transition_count count; runtime_receipt.h1_count count;
        runtime_receipt.m1_count count; runtime_receipt.anomaly_count count; runtime_receipt.query_present flag; runtime_receipt.skipped_window_count count;
        runtime_receipt.merge_failure_count count; substrate_handles object; substrate_handles.latest_committed_state_id text?;
        substrate_handles.latest_committed_memory_object_id text?; substrate_handles.recent_committed_handle_pairs list;
        substrate_handles.handle_authority typed_refs_only_read_side; substrate_handles.payload_included no; claim_posture object;
        claim_posture.authority read_side_only; claim_posture.forbidden some names""",
    "model_output": """
        closed; response_type const; input_stream_id text?; observations names; questions names; non_claims some names; authority_posture object;
        authority_posture.read_side_only yes; authority_posture.canon_authority no; authority_posture.runtime_authority no; authority_posture.truth_closure no;
        authority_posture.identity_closure no; authority_posture.same_object_closure no; authority_posture.promotion_authority no""",
    "benchmark_receipt": """
        closed; receipt_type const; receipt_version const; benchmark_id name; model_id name; endpoint name; threading_mode fresh_request;
        input_ref object; input_ref.lm_input_path name; input_ref.prompt_path name; run_ref object; run_ref.run_dir name; run_ref.run_index index;
        request_config object; request_config.temperature size; contract_obedience object; contract_obedience.json_parse_ok flag; contract_obedience.schema_ok flag;
        contract_obedience.no_extra_text flag; contract_obedience.exact_response_type flag; contract_obedience.required_non_claims_present flag;
        contract_obedience.correct_authority_posture flag; contract_obedience.passed flag; repeatability_surface object;
        repeatability_surface.raw_output_hash name; repeatability_surface.normalized_output_hash text?; repeatability_surface.observation_count count;
        repeatability_surface.question_count count; usefulness object; usefulness.observation_count count; usefulness.question_count count;
        usefulness.authority_drift_count count; usefulness.empty_observation_count count; usefulness.duplicate_question_count count;
        response_ref object; response_ref.raw_path name; response_ref.parsed_path name; response_ref.validation_path name; response_ref.benchmark_path name;
        api_stats object+; api_stats.* any""",
}


def rules(name: str) -> tuple[list[tuple[str, str]], bool]:
    """(path, rule) of a format in order, and whether it is closed."""
    parts = [x.strip() for x in FORMATS[name].split(";")]
    pairs = [tuple(x.split(None, 1)) for x in parts if x != "closed"]
    return [(path, rule) for path, rule in pairs], parts[0] == "closed"


def _kind(value: Column) -> Column:
    """A VARIANT's type as text, ``VOID`` for a JSON null, null where the path leads nowhere."""
    return F.when(value.isNotNull(), F.schema_of_variant(value))


def _whole(value: Column, least: int) -> Column:
    number = F.try_variant_get(value, "$", "double")
    return F.coalesce(_kind(value).rlike("^(BIGINT|DECIMAL|DOUBLE)") & (number == F.floor(number)) & (number >= least), F.lit(False))


def _names(value: Column, least: int) -> Column:
    items = F.try_variant_get(value, "$", "array<variant>")
    good = F.forall(items, lambda x: F.coalesce((_kind(x) == "STRING") & (F.length(F.try_variant_get(x, "$", "string")) > 0), F.lit(False)))
    return F.coalesce(_kind(value).startswith("ARRAY") & (F.size(items) >= least) & good, F.lit(False))


def _holds(value: Column, rule: str, const) -> Column:
    kind, text = F.coalesce(_kind(value), F.lit("")), F.try_variant_get(value, "$", "string")
    is_text = kind == "STRING"
    if rule[-1] in "?+":
        free = (kind == "VOID") | (value.isNull() if rule[-1] == "+" else F.lit(False))
        return free | _holds(value, rule[:-1], const)
    found = {
        "object": lambda: kind.startswith("OBJECT"),
        "list": lambda: kind.startswith("ARRAY"),
        "text": lambda: is_text,
        "name": lambda: is_text & (F.length(text) > 0),
        "flag": lambda: kind == "BOOLEAN",
        "yes": lambda: (kind == "BOOLEAN") & (text == "true"),
        "no": lambda: (kind == "BOOLEAN") & (text == "false"),
        "count": lambda: _whole(value, 0),
        "index": lambda: _whole(value, 1),
        "size": lambda: kind.rlike("^(BIGINT|DECIMAL|DOUBLE)") & (F.try_variant_get(value, "$", "double") >= 0),
        "names": lambda: _names(value, 0),
        "some names": lambda: _names(value, 1),
        "const": lambda: is_text & (text == const),
    }.get(rule, lambda: is_text & text.isin(rule.split("|")))
    return F.coalesce(found(), F.lit(False))


def broken(document: Column, name: str, **constants: str) -> Column:
    """The paths of a JSON text that break the format ``name``; ``$`` where it is no object.  ``constants`` are the values of its ``const`` paths."""
    pairs, closed = rules(name)
    missing = [path for path, rule in pairs if rule == "const" and path not in constants]
    if missing:
        raise ValueError(f"{name} needs a value for {', '.join(missing)}")
    whole = F.try_parse_json(document)
    at = lambda path: F.try_variant_get(whole, f"$.{path}", "variant")
    is_object = lambda path: F.coalesce(_kind(at(path) if path else whole).startswith("OBJECT"), F.lit(False))
    above = lambda path: path.rpartition(".")[0]
    out = [F.when(is_object(above(path)) & ~_holds(at(path), rule, constants.get(path)), F.lit(path)) for path, rule in pairs if rule != "any"]
    found = F.array_compact(F.array(*out))
    if closed:
        open_at = {above(path) for path, rule in pairs if rule == "any"}
        for parent in dict.fromkeys(["", *(path for path, rule in pairs if rule.startswith("object"))]):
            if parent in open_at:
                continue
            known = [path.rpartition(".")[2] for path, _ in pairs if above(path) == parent]
            keys = F.coalesce(F.json_object_keys(F.get_json_object(document, f"$.{parent}") if parent else document), F.array().cast("array<string>"))
            extra = F.array_sort(F.array_except(keys, F.array(*map(F.lit, known))))
            head = F.lit(f"{parent}." if parent else "")
            found = F.concat(found, F.when(is_object(parent), F.transform(extra, lambda k: F.concat(head, k))).otherwise(F.array().cast("array<string>")))  # noqa: B023
    return F.when(is_object(""), found).otherwise(F.array(F.lit("$")))


#: Where a probe report may keep its rows, its summary, and evidence of what it doesn't claim, the first found counting (fixed values).
ROWS_AT = ("per_run_rows", "per_cohort_rows", "labeled_replay.per_run_rows")
SUMMARY_AT = ("probe_summary", "replay_summary", "labeled_replay.replay_summary", "cross_family_summary")
NOT_CANON_AT = ("disclaimers.not_canon", "replay_summary.not_canon", "labeled_replay.replay_summary.not_canon", "cross_family_summary.not_canon")
NOT_PREDICTION_AT = ("replay_summary.not_prediction", "labeled_replay.replay_summary.not_prediction", "cross_family_summary.not_prediction", "constitutional_posture.no_prediction_claims")


def probe_receipt(report: Column, report_path: Column | None = None, receipt_type: str = "runtime:probe_report_receipt", version: str = "0.1.0") -> Column:
    """The receipt (struct) of a probe report (JSON text): where rows and summary are, what is declared, how much is compared."""
    whole = F.try_parse_json(report)
    at = lambda path: F.try_variant_get(whole, f"$.{path}", "variant")
    is_list = lambda path: F.coalesce(_kind(at(path)).startswith("ARRAY"), F.lit(False))
    length = lambda path: F.when(is_list(path), F.size(F.try_variant_get(whole, f"$.{path}", "array<variant>"))).otherwise(0)
    # a summary is an object or a list
    has = lambda path: F.coalesce(_kind(at(path)).rlike("^(OBJECT|ARRAY)"), F.lit(False))
    true_at = lambda paths: F.greatest(*[F.coalesce((_kind(at(p)) == "BOOLEAN") & F.try_variant_get(whole, f"$.{p}", "boolean"), F.lit(False)) for p in paths])
    said = lambda path: F.coalesce(~_kind(at(path)).isin("VOID") & ~F.coalesce(F.try_variant_get(whole, f"$.{path}", "string"), F.lit("{}")).isin("false", "0", ""), F.lit(False))
    first = lambda paths, there: F.coalesce(*[F.when(there(p), F.lit(p)) for p in paths], F.lit("none"))
    rows = F.coalesce(*[F.when(is_list(p), length(p)) for p in ROWS_AT], F.lit(0))
    kind = F.coalesce(F.when(_kind(at("probe_type")) != "VOID", F.try_variant_get(whole, "$.probe_type", "string")), F.lit("unknown_probe_report"))
    return F.struct(
        F.lit(receipt_type).alias("receipt_type"),
        F.lit(version).alias("receipt_version"),
        kind.alias("probe_type"),
        F.struct(first(ROWS_AT, is_list).alias("path"), rows.alias("row_count")).alias("row_surface"),
        F.struct(first(SUMMARY_AT, has).alias("path"), F.greatest(*map(has, SUMMARY_AT)).alias("available")).alias("summary_surface"),
        F.struct(said("constitutional_posture").alias("has_constitutional_posture"), said("disclaimers").alias("has_disclaimers"), true_at(NOT_CANON_AT).alias("not_canon_evidence"), true_at(NOT_PREDICTION_AT).alias("not_prediction_evidence")).alias("posture_flags"),
        F.struct(F.lit(True).alias("advisory_only"), F.lit(True).alias("read_side_only"), F.lit(False).alias("runtime_authority"), F.lit(False).alias("canon_authority")).alias("authority_posture"),
        F.struct(length("comparisons").alias("comparison_count"), length("family_summaries").alias("family_summary_count")).alias("counts"),
        F.struct((F.lit(None).cast("string") if report_path is None else report_path).alias("report_path")).alias("report_ref"),
    )
