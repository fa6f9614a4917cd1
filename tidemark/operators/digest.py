"""Cycle receipts: structural markers, changes from one cycle to the next, and counts over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARKERS = ("recurrence", "convergence", "motion", "occupancy", "continuity", "source_mode")


def markers(novelty: Column, transitions: Column, basins: Column, re_entries: Column, segments: Column) -> dict[str, Column]:
    """What a run's counts show; null counts as 0."""
    n = lambda c: F.coalesce(c, F.lit(0))
    pick = lambda cond, yes, no: F.when(cond, F.lit(yes)).otherwise(F.lit(no))
    return {
        "convergence": pick(n(novelty) > 0, "novelty_observed", "novelty_quiet"),
        "motion": pick(n(transitions) > 0, "transitions_observed", "transition_quiet"),
        "occupancy": F.when(n(basins) > 1, F.lit("multi_basin_observed")).when(n(basins) == 1, F.lit("single_basin_observed")).otherwise(F.lit("basin_absent")),
        "recurrence": pick(n(re_entries) > 0, "re_entry_observed", "re_entry_absent"),
        "continuity": pick(n(segments) > 1, "multi_segment_observed", "single_segment_observed"),
    }


def known(c: str) -> Column:
    return F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown"))


def deltas(cycles: DataFrame, by: str) -> DataFrame:
    """Each cycle against the one before it in its session: changed, no_change, or n/a for the first."""
    order = Window.partitionBy(by).orderBy("cycle_index")
    first = F.lag("cycle_index").over(order).isNull()
    same = lambda c: F.when(first, F.lit("n/a")).when(F.col(c).eqNullSafe(F.lag(c).over(order)), F.lit("no_change")).otherwise(F.lit("changed"))
    return cycles.select(by, "cycle_index", *[same(c).alias(f"{c}_changed") for c in ("state_count", "convergence", "recurrence")])


def changes(cycles: DataFrame, by: str) -> DataFrame:
    """How often each value changed from one cycle to the next."""
    order = Window.partitionBy(by).orderBy("cycle_index")
    names = {"state_count": "state_count_changed_count", "recurrence": "recurrence_changed_count", "convergence": "convergence_changed_count", "stream_id": "stream_switch_count"}
    rows = cycles
    for c in names:
        rows = rows.withColumn(f"__{c}", F.lag("cycle_index").over(order).isNotNull() & ~F.col(c).eqNullSafe(F.lag(c).over(order)))
    return rows.groupBy(by).agg(*[F.count_if(F.col(f"__{c}")).alias(name) for c, name in names.items()])


def counts(cycles: DataFrame, by: str, names: tuple[str, ...] = MARKERS) -> DataFrame:
    """``by, marker, value, count`` for every marker."""
    long = cycles.select(by, F.explode(F.array(*[F.struct(F.lit(m).alias("marker"), known(m).alias("value")) for m in names])).alias("m")).select(by, "m.*")
    return long.groupBy(by, "marker", "value").agg(F.count(F.lit(1)).alias("count"))


def scope(cycles: DataFrame, by: str) -> DataFrame:
    some = lambda c: F.array_sort(F.collect_set(F.coalesce(F.col(c).cast("string"), F.lit("unknown"))))
    return cycles.groupBy(by).agg(F.count(F.lit(1)).alias("receipt_count"), F.min("cycle_index").alias("cycle_index_min"), F.max("cycle_index").alias("cycle_index_max"), some("stream_id").alias("stream_ids"), some("source_mode").alias("source_modes"))


def retained(cycles: DataFrame, by: str, keep: int) -> DataFrame:
    """Adds ``pruned``: true for all but the newest ``keep`` cycles."""
    newest = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("cycle_index")))
    return cycles.withColumn("pruned", newest > keep)


#: Lines of a cycle's text: label and columns, with what stands for a null (fixed texts).
SUMMARY = (
    ("", ()),
    ("Cycle {0}", (("cycle_index", "-"),)),
    ("  run_label: {0}", (("run_label", "-"),)),
    ("  stream_id: {0}", (("stream_id", "-"),)),
    ("", ()),
    ("  run_health:", ()),
    ("    states={0}  basins={1}  segments={2}  skipped={3}  merge_failures={4}", (("state_count", "0"), ("basin_count", "0"), ("segment_count", "0"), ("skipped_windows", "0"), ("merge_failures", "0"))),
    ("", ()),
    ("  structure:", ()),
    ("    convergence={0}", (("convergence", "-"),)),
    ("    motion={0}", (("motion", "-"),)),
    ("    occupancy={0}", (("occupancy", "-"),)),
    ("    recurrence={0}", (("recurrence", "-"),)),
    ("    continuity={0}", (("continuity", "-"),)),
    ("", ()),
    ("  delta_vs_prev:", ()),
    ("    state_count={0}", (("state_count_changed", "-"),)),
    ("    convergence={0}", (("convergence_changed", "-"),)),
    ("    recurrence={0}", (("recurrence_changed", "-"),)),
    ("    cross_run_count={0}", (("cross_run_count", "0"),)),
    ("", ()),
)


def summary_text(columns: list[str]) -> Column:
    """A cycle's row as text; columns that the table lacks count as null."""
    lines = []
    for text, parts in SUMMARY:
        pieces, rest = [], text
        for i, (name, none) in enumerate(parts):
            head, rest = rest.split(f"{{{i}}}")
            value = F.col(name).cast("string") if name in columns else F.lit(None).cast("string")
            pieces += [F.lit(head), F.coalesce(value, F.lit(none))]
        lines.append(F.concat(*pieces, F.lit(rest)))
    return F.array_join(F.array(*lines), "\n")
