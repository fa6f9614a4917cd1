"""Committed states, the objects and graph derived from them, and similarity edges.

Committing is an anti-join against what is stored plus a first-of-its-id
choice; nodes, edges and ledger events are projections of the commit order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import l1
from .neighborhoods import around, cells

GROUP = "stream_id"
#: Edges derived from similarity (fixed values).
DERIVED, DERIVED_LAYER = "structural_similarity", "L2"


def legitimacy(states: DataFrame) -> DataFrame:
    """Adds ``reasons``: why a state can't be committed; empty if it can.  Columns that a table lacks count as missing values."""
    have = set(states.columns)
    col = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    blank = lambda c: col(c).isNull() | (col(c) == "")
    odd = lambda c: col(c, "double").isNull() | F.isnan(col(c, "double")) | (F.abs(col(c, "double")) == float("inf"))
    empty = lambda c, kind: col(c, kind).isNull() | (F.size(col(c, kind)) == 0)
    checks = [
        (~F.coalesce(col("artifact_class").isin("H1", "M1"), F.lit(False)), "state must be a valid H1 or M1 artifact"),
        (blank("state_id"), "state_id must be a non-empty string"),
        (blank("stream_id"), "stream_id must be a non-empty string"),
        (blank("segment_id"), "segment_id must be a non-empty string"),
        (odd("t_start") | odd("t_end"), "window_span must have finite t_start and t_end"),
        (col("profile", "array<double>").isNull(), "band profile required for indexing"),
        (blank("compression_policy_id") & blank("merge_policy_id"), "policies must contain compression_policy_id or merge_policy_id"),
        (blank("clock_policy_id"), "clock_policy_id is required"),
        (empty("input_refs", "array<string>"), "input_refs must be a non-empty array"),
        (odd("rate") | odd("size") | odd("df"), "grid must have finite rate, size and df"),
        (odd("energy_raw"), "energy_raw must be finite"),
        (col("uncertainty_time").isNull(), "uncertainty_time must be present"),
        (empty("kept_bins", "array<struct<k:int>>"), "kept_bins must be a non-empty array"),
        (odd("confidence"), "confidence must be a finite number"),
    ]
    return states.withColumn("reasons", F.array_compact(F.array(*[F.when(bad, F.lit(why)) for bad, why in checks])))


def commit(new: DataFrame, stored: DataFrame | None = None, order: str = "commit_idx") -> DataFrame:
    """The rows of ``new`` whose ``state_id`` isn't stored yet, the first of each."""
    first = Window.partitionBy("state_id").orderBy(order)
    rows = new.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return rows if stored is None else rows.join(stored.select("state_id"), "state_id", "left_anti")


def object_id(state_id: Column) -> Column:
    return F.concat(F.lit("MO:"), state_id)


def objects(states: DataFrame) -> DataFrame:
    """Envelopes of committed states: kind, extent, relation slots."""
    inputs = F.col("merged_from") if "merged_from" in states.columns else F.array().cast("array<string>")
    refs = F.col("input_refs") if "input_refs" in states.columns else F.array().cast("array<string>")
    slot = lambda xs, kind: F.transform(xs, lambda r: F.struct(F.lit(kind).alias("relation_type"), r.alias("ref")))
    merged = F.col("artifact_class") == "M1"
    return states.select(
        object_id(F.col("state_id")).alias("memory_object_id"), "state_id", "artifact_class", "stream_id", "segment_id", "t_start", "t_end",
        F.when(merged, F.lit("m1_support")).otherwise(F.lit("h1_support")).alias("payload_kind"),
        F.when(merged, F.lit("derived_merge")).otherwise(F.lit("temporal_stream")).alias("admission_mode"),
        F.struct(
            slot(refs, "derived_from").alias("provenance"),
            slot(F.array("state_id"), "payload_support").alias("support_composition"),
            slot(F.array_distinct(F.coalesce(inputs, F.array().cast("array<string>"))), "merge_input").alias("merge_lineage"),
            slot(F.array(F.lit("band_profile_norm"), F.lit("kept_bins")), "comparison_basis").alias("comparison_basis"),
            slot(F.array("state_id"), "reconstructable_from_payload").alias("reconstruction_source"),
            slot(F.array("state_id"), "payload_ref").alias("retrieval_consult"),
        ).alias("relation_slots"),
    )


def lookup(found: DataFrame, ref: str) -> DataFrame:
    """An object by its own id or its state's."""
    return found.where((F.col("memory_object_id") == ref) | (F.col("state_id") == ref))


def edges(states: DataFrame, order: str = "commit_idx") -> DataFrame:
    """Payload, temporal and lineage edges of committed states; ``event_index`` is the commit's place."""
    node = object_id(F.col("state_id"))
    rows = states.withColumn("node", node).withColumn("event_index", F.col(order).cast("long"))
    rows = rows.withColumn("before", F.lag("node").over(Window.partitionBy("stream_id").orderBy(order)))
    edge = lambda kind, a, b: F.struct(F.lit(kind).alias("edge_type"), a.alias("from"), b.alias("to"))
    found = F.array(edge("payload_ref", F.col("node"), F.col("state_id")), F.when(F.col("before").isNotNull(), edge("temporal_next", F.col("before"), F.col("node"))))
    if "merged_from" in states.columns:
        lineage = F.transform(F.array_distinct(F.coalesce("merged_from", F.array().cast("array<string>"))), lambda r: edge("merge_lineage_ref", F.col("node"), r))
        found = F.concat(found, lineage)
    out = rows.select("event_index", F.explode(F.array_compact(found)).alias("e")).select("event_index", "e.*")
    return out.withColumn("edge_id", F.concat_ws(":", F.lit("GE"), F.col("event_index").cast("string"), "edge_type", "from", "to"))


def ledger(states: DataFrame, order: str = "commit_idx") -> DataFrame:
    """One event a commit, with the edges it added."""
    added = edges(states, order).groupBy("event_index").agg(F.array_sort(F.collect_list("edge_id")).alias("edges_added"))
    return states.select(F.col(order).cast("long").alias("event_index"), object_id(F.col("state_id")).alias("node_id"), "state_id").join(added, "event_index")


def state_view(states: DataFrame, limit: int = 5, stream_id: str | None = None, segment_id: str | None = None, order: str = "commit_idx") -> tuple[DataFrame, DataFrame]:
    """(the last ``limit`` nodes in scope, all edges that touch one of them)."""
    some = states
    if stream_id is not None:
        some = some.where(F.col("stream_id") == stream_id)
    if segment_id is not None:
        some = some.where(F.col("segment_id") == segment_id)
    nodes = some.orderBy(F.desc(order)).limit(limit).select(object_id(F.col("state_id")).alias("node_id"), "state_id", "stream_id", "segment_id", F.col(order).alias("commit_idx"))
    ids = F.broadcast(nodes.select("node_id"))  # limit rows at most
    all_edges = edges(states, order)
    return nodes, all_edges.join(ids, (F.col("from") == F.col("node_id")) | (F.col("to") == F.col("node_id")), "left_semi")


@dataclass(frozen=True)
class Similarity:
    policy_id: str = "graph_relation.structural_similarity.v1"
    spectral_threshold: float = 0.35
    amplitude_threshold: float | None = None
    stream_id: str | None = None
    segment_id: str | None = None
    artifact_class: str | None = None


def similarity_edges(states: DataFrame, policy: Similarity = Similarity(), known: DataFrame | None = None, order: str = "commit_idx") -> DataFrame:
    """Pairs in commit order whose profiles and energies are close enough, but for those already known under the policy.

    Candidates meet in cells of the threshold's width.  A state without a
    profile or an energy is similar to none.
    """
    some = states
    for c in ("stream_id", "segment_id", "artifact_class"):
        if getattr(policy, c) is not None:
            some = some.where(F.col(c) == getattr(policy, c))
    x, y = cells(F.col("profile"), policy.spectral_threshold)
    node = object_id(F.col("state_id"))
    left = some.select(node.alias("from"), F.col(order).alias("i"), F.col("profile").alias("p"), F.col("energy_raw").alias("e"), around(x).alias("x"), y.alias("__y"))
    left = left.select("from", "i", "p", "e", "x", around(F.col("__y")).alias("y"))
    right = some.select(node.alias("to"), F.col(order).alias("j"), F.col("profile").alias("q"), F.col("energy_raw").alias("f"), x.alias("x"), y.alias("y"))
    pairs = left.join(right, ["x", "y"]).where("i < j and size(p) = size(q) and size(p) > 0")
    pairs = pairs.withColumns({"spectral_distance": l1(F.col("p"), F.col("q")), "amplitude_distance": F.abs(F.col("e") - F.col("f"))})
    near = F.col("spectral_distance") <= policy.spectral_threshold
    near = near & (F.col("amplitude_distance").isNotNull() if policy.amplitude_threshold is None else F.col("amplitude_distance") <= policy.amplitude_threshold)
    out = pairs.where(near).select("from", "to", "spectral_distance", "amplitude_distance", F.lit(policy.policy_id).alias("policy_id"))
    return out if known is None else out.join(known.select("from", "to", "policy_id"), ["from", "to", "policy_id"], "left_anti")


def derived_edges(similar: DataFrame, edge_type: str | None = None, start: str | None = None, end: str | None = None, layer: str | None = None, policy_id: str | None = None, event_index: int = 0) -> DataFrame:
    """The similarity edges that event ``event_index`` derived as rows of the graph, those that fit all filters given."""
    rows = similar.select(F.concat_ws(":", F.lit("GDE"), F.lit(str(event_index)), F.lit(DERIVED), "from", "to").alias("edge_id"), F.lit(DERIVED).alias("edge_type"), F.lit(DERIVED_LAYER).alias("layer"), "from", "to", "policy_id", "spectral_distance", "amplitude_distance")
    for column, wanted in (("edge_type", edge_type), ("from", start), ("to", end), ("layer", layer), ("policy_id", policy_id)):
        if wanted is not None:
            rows = rows.where(F.col(column) == wanted)
    return rows


def committed(new: DataFrame, stored: DataFrame | None = None, clusters: DataFrame | None = None, threshold: float | None = None, order: str = "commit_idx", by: str = "segment_id") -> tuple[DataFrame, DataFrame]:
    """(states to add, each with its object's id and its nearest cluster; what was refused or stored before, with ``outcome`` and ``reasons``).

    The gate comes first, then a choice by ``state_id``; a state that is added
    gets the closest of its segment's ``clusters`` (``by, label, centroid``)
    within the threshold.
    """
    from .neighborhoods import nearest

    judged = legitimacy(new)
    lawful = judged.where(F.size("reasons") == 0)
    added = commit(lawful.drop("reasons"), stored, order).withColumn("memory_object_id", object_id(F.col("state_id")))
    refused = judged.where(F.size("reasons") > 0).select("state_id", order, F.lit("LEGITIMACY_FAILURE").alias("outcome"), "reasons")
    again = lawful.join(added.select("state_id", order), ["state_id", order], "left_anti").select("state_id", order, F.lit("DUPLICATE").alias("outcome"), "reasons")
    if clusters is None:
        added = added.withColumns({"nearest": F.lit(None).cast("long"), "distance": F.lit(None).cast("double")})
    else:
        added = nearest(added.withColumn("node", F.col("state_id")), clusters, threshold, by).drop("node")
    return added, refused.unionByName(again)


def summary(states: DataFrame) -> DataFrame:
    """Counts of what is committed; the span runs from the first start to the end of the state that starts last."""
    return states.agg(F.count(F.lit(1)).alias("state_count"), F.count_distinct("segment_id").alias("segment_count"), F.count_distinct("stream_id").alias("stream_count"), F.min("t_start").alias("t_start"), F.max_by("t_end", "t_start").alias("t_end"), F.max_by("state_id", "commit_idx").alias("latest_committed_state_id"))
