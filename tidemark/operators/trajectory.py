"""Visits of states in commit order: transitions, dwell, recurrence, velocity, convergence.

Frames: ``stream_id, frame_index, t_start, t_end, segment_id, basin_id,
distance, profile``; ``by`` names the columns inside which frames follow each
other (a stream, or a stream and segment).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import l1

BY = ("stream_id",)


def _order(by: tuple[str, ...]):
    return Window.partitionBy(*by).orderBy("frame_index")


def retained(frames: DataFrame, most: int = 1024, by: tuple[str, ...] = BY) -> DataFrame:
    """The last ``most`` frames."""
    last = F.max("frame_index").over(Window.partitionBy(*by))
    return frames.where(F.lit(True)).withColumn("__last", last).where(F.col("frame_index") > F.col("__last") - most).drop("__last")


def tail(frames: DataFrame, n: int, by: tuple[str, ...] = BY) -> DataFrame:
    """The last ``n`` frames, with ``back`` from 1 for the newest."""
    return frames.withColumn("back", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("frame_index")))).where(F.col("back") <= n)


def contained(frames: DataFrame, begin: float, end: float) -> DataFrame:
    return frames.where((F.col("t_start") >= begin) & (F.col("t_end") <= end))


def transitions(frames: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Adjacent frames in different neighborhoods, both known."""
    rows = frames.withColumn("from", F.lag("basin_id").over(_order(by)))
    return rows.where(F.col("from").isNotNull() & (F.col("from") != F.col("basin_id"))).select(*by, "from", F.col("basin_id").alias("to"), F.col("t_start").alias("t_transition"), "frame_index")


def transition_counts(frames: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    return transitions(frames, by).groupBy(*by, "from", "to").agg(F.count(F.lit(1)).alias("count"))


def _runs(frames: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Contiguous frames of one known neighborhood: ``run, frames, duration``."""
    opens = F.when(F.col("basin_id").eqNullSafe(F.lag("basin_id").over(_order(by))), 0).otherwise(1)
    rows = frames.withColumn("opens", opens).withColumn("run", F.sum("opens").over(_order(by)))
    return rows.where("basin_id is not null").groupBy(*by, "basin_id", "run").agg(F.count(F.lit(1)).alias("frames"), (F.max_by("t_end", "frame_index") - F.min_by("t_start", "frame_index")).alias("duration"), F.sum(F.col("t_end") - F.col("t_start")).alias("frame_time"), F.max("frame_index").alias("last"))


def dwell(frames: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Runs, frames and time of each neighborhood; a run lasts from its first start to its last end."""
    return _runs(frames, by).groupBy(*by, "basin_id").agg(F.count(F.lit(1)).alias("dwell_runs"), F.sum("frames").alias("total_frames"), F.sum("duration").alias("total_duration_sec"), F.avg("duration").alias("mean_duration_sec"))


def recurrence(frames: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """How often each neighborhood is entered again."""
    return dwell(frames, by).select(*by, "basin_id", "dwell_runs", (F.col("dwell_runs") - 1).alias("re_entry_count"))


def current(frames: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """The newest frame's neighborhood, the frames that end in it, and the sum of their times."""
    newest = frames.groupBy(*by).agg(F.max("frame_index").alias("last"), F.max_by("basin_id", "frame_index").alias("current_neighborhood_id"))
    run = _runs(frames, by).select(*by, "last", F.col("frames").alias("n"), "frame_time")
    return newest.join(run, [*by, "last"], "left").select(*by, "current_neighborhood_id", F.coalesce("n", F.lit(0)).alias("current_dwell_count"), F.coalesce("frame_time", F.lit(0.0)).alias("current_dwell_duration_sec"))


def velocity(frames: DataFrame, n: int = 8, by: tuple[str, ...] = BY) -> DataFrame:
    """Mean and greatest distance of adjacent profiles over the last ``n + 1`` frames."""
    rows = tail(frames, n + 1, by)
    step = l1(F.col("profile"), F.lag("profile").over(_order(by)))
    rows = rows.withColumn("step", F.when(F.lag("frame_index").over(_order(by)).isNotNull(), step))
    out = rows.groupBy(*by).agg(F.coalesce(F.avg("step"), F.lit(0.0)).alias("mean_l1_delta"), F.coalesce(F.max("step"), F.lit(0.0)).alias("max_l1_delta"), F.count(F.lit(1)).alias("frames_used"))
    return out.withColumn("sufficient_data", F.col("frames_used") >= 2)


def convergence(frames: DataFrame, n: int = 8, by: tuple[str, ...] = BY) -> DataFrame:
    """Slope of the distance to the centroid over those of the last ``n`` frames that have one."""
    rows = tail(frames, n, by).where("distance is not null").withColumn("x", (F.row_number().over(_order(by)) - 1).cast("double"))
    slope = F.when(F.var_pop("x") == 0, F.lit(0.0)).otherwise(F.covar_pop("x", "distance") / F.var_pop("x"))
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("frames_used"), slope.alias("slope"))
    enough = F.col("frames_used") >= 2
    return out.select(*by, (enough & (F.col("slope") < 0)).alias("is_converging"), F.when(enough, F.col("slope")).alias("trend_slope"), "frames_used", enough.alias("sufficient_data"))


def summary(frames: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    return frames.groupBy(*by).agg(
        F.count(F.lit(1)).alias("frame_count"),
        F.min_by("t_start", "frame_index").alias("t_start"),
        F.max_by("t_end", "frame_index").alias("t_end"),
        F.count_distinct("segment_id").alias("segment_count"),
        F.count_distinct("basin_id").alias("basin_count"),
        F.count_if("novelty").alias("novelty_event_count"),
        F.avg("confidence").alias("mean_confidence"),
        F.avg("energy_raw").alias("mean_energy_raw"),
    )


def segment_order(frames: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Segments by first appearance."""
    return frames.groupBy(*by, "segment_id").agg(F.min("frame_index").alias("first_frame"))


def report(frames: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """One row a group: totals of transitions, re-entries and neighborhoods, and the current dwell."""
    base = frames.groupBy(*by).agg(F.count(F.lit(1)).alias("total_frames_considered"), F.count_distinct("basin_id").alias("total_neighborhoods_observed"), F.array_sort(F.collect_set("basin_id")).alias("neighborhoods_seen"))
    moves = transitions(frames, by).groupBy(*by).agg(F.count(F.lit(1)).alias("moves"))
    again = recurrence(frames, by).groupBy(*by).agg(F.sum("re_entry_count").alias("again"))
    out = base.join(moves, list(by), "left").join(again, list(by), "left").join(current(frames, by), list(by))
    return out.withColumns({"total_transitions": F.coalesce("moves", F.lit(0)), "total_re_entries": F.coalesce("again", F.lit(0))}).drop("moves", "again")
