"""Count-based frames of aligned streams: cut, repaired, tapered, with receipts.

A grid point goes to every frame that covers it; fills and receipts are window
functions inside a frame, so they share the frame's one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, taper
from ..plans.policies import Frame


def _slots(aligned: DataFrame, spec: Frame) -> DataFrame:
    """``stream_id, w, n, t0, len, size, v``: the frames' samples in place ``n``, with the stream's length and the frame's size."""
    if spec.mode != "fixed":
        raise NotImplementedError(f"window mode {spec.mode}")
    n, hop = spec.size, spec.hop
    if n <= 0 or hop <= 0:
        raise ValueError("frame size and hop must be positive")
    low = F.greatest(F.lit(0), F.ceil((F.col("i") - (n - 1)) / F.lit(hop))).cast("long")
    high = F.floor(F.col("i") / F.lit(hop)).cast("long")
    placed = aligned.withColumn("v", F.nanvl("v", F.lit(None).cast("double"))).where(low <= high).withColumn("w", F.explode(F.sequence(low, high)))
    placed = placed.withColumn("n", F.col("i") - F.col("w") * hop)
    length = aligned.groupBy("stream_id").agg((F.max("i") + 1).alias("len"), F.min_by("tq", "i").alias("__t0"), F.min("i").alias("__i0"))
    placed = placed.join(length, "stream_id")
    left = F.least(F.lit(n), F.col("len") - F.col("w") * hop)
    rows = placed.select("stream_id", "w", "n", (F.col("__t0") + F.col("w") * hop * F.lit(1.0 / spec.rate)).alias("t0"), "len", left.cast("int").alias("held"), "v")
    if spec.boundary_policy == "truncate":
        return rows.withColumn("size", F.col("held"))
    short = rows.where(F.col("held") < n)
    if spec.boundary_policy == "mirror_pad":
        # the held samples, then they and their mirror image in turn
        period = 2 * F.col("held")
        place = F.when(F.pmod(F.col("p"), period) < F.col("held"), F.pmod(F.col("p"), period)).otherwise(period - 1 - F.pmod(F.col("p"), period))
        more = short.withColumn("p", F.explode(F.sequence(F.col("held").cast("long"), F.lit(n - 1).cast("long")))).where(place == F.col("n")).withColumn("n", F.col("p")).drop("p")
    else:
        one = short.where("n = 0")
        more = one.withColumn("n", F.explode(F.sequence(F.col("held").cast("long"), F.lit(n - 1).cast("long")))).withColumn("v", F.lit(None).cast("double"))
    return rows.unionByName(more).withColumn("size", F.lit(n))


def _filled(spec: Frame) -> Column:
    frame = Window.partitionBy("stream_id", "w").orderBy("n")
    before, after = frame.rowsBetween(Window.unboundedPreceding, -1), frame.rowsBetween(1, Window.unboundedFollowing)
    held = F.struct("n", "v")
    known = F.when(F.col("v").isNotNull(), held)
    left, right = F.last(known, True).over(before), F.first(known, True).over(after)
    if spec.gap_policy == "hold_last":
        return F.coalesce(F.col("v"), left["v"])
    if spec.gap_policy == "interpolate_small":
        alpha = (F.col("n") - left["n"]) / (right["n"] - left["n"])
        return F.coalesce(F.col("v"), left["v"] + alpha * (right["v"] - left["v"]))
    return F.col("v")


def _stationarity(xs: Column) -> Column:
    """1 less the relative drift of mean and variance between the halves; null for fewer than 4 values."""
    n = F.size(xs)
    half = F.floor(n / 2).cast("int")
    parts = F.slice(xs, F.lit(1), F.greatest(half, F.lit(1))), F.slice(xs, half + 1, F.greatest(n - half, F.lit(1)))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    spread = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean(a)) * (x - mean(a))) / F.size(a)
    m1, m2, v1, v2 = mean(parts[0]), mean(parts[1]), spread(parts[0]), spread(parts[1])
    drift = F.abs(m2 - m1) + F.abs(v2 - v1)
    return F.when(n >= 4, clamp(F.lit(1.0) - F.least(F.lit(1.0), drift / (F.abs(m1) + F.abs(m2) + v1 + v2 + F.lit(1e-9)))))


def frames(aligned: DataFrame, spec: Frame = Frame()) -> DataFrame:
    """One row a frame: ``stream_id, w, t0, size, raw, windowed`` (arrays in order) and its receipt.

    With ``truncate`` the last frame is the first one that reaches the end and
    isn't refused; frames with too many missing samples are left out.
    """
    frame = Window.partitionBy("stream_id", "w")
    rows = _slots(aligned, spec).withColumn("filled", _filled(spec))
    gone = F.col("v").isNull()
    opens = gone & F.coalesce(F.lag("v").over(frame.orderBy("n")).isNotNull() | (F.col("n") == 0), F.lit(True))
    rows = rows.withColumn("opens", opens).withColumn("windowed", F.col("filled") * taper(spec.window_function, F.col("n"), F.col("size")))
    out = rows.groupBy("stream_id", "w").agg(
        F.max("t0").alias("t0"),
        F.max("size").cast("int").alias("size"),
        F.max("len").alias("len"),
        F.max("held").alias("held"),
        F.transform(F.array_sort(F.collect_list(F.struct("n", "filled"))), lambda x: x["filled"]).alias("raw"),
        F.transform(F.array_sort(F.collect_list(F.struct("n", "windowed"))), lambda x: x["windowed"]).alias("windowed"),
        F.count_if(gone).alias("missing"),
        F.count_if(F.col("opens")).alias("gap_count"),
    )
    out = out.withColumn("missing_ratio", F.col("missing") / F.col("size")).where(F.col("missing_ratio") <= spec.max_missing_ratio)
    if spec.boundary_policy == "truncate":
        ends = F.col("w") * spec.hop + spec.size >= F.col("len")
        reached = F.min(F.when(ends, F.col("w"))).over(Window.partitionBy("stream_id"))
        out = out.withColumns({"ends": ends, "reached": reached}).where(~F.col("ends") | (F.col("w") == F.col("reached"))).drop("ends", "reached")
    short = F.col("held") < spec.size
    known = F.filter("raw", lambda x: x.isNotNull())
    clipped = short if spec.boundary_policy == "truncate" else F.lit(False)
    return out.select(
        "stream_id", "w", "t0", "size", "raw", "windowed", "missing_ratio", "gap_count",
        (F.col("missing") * F.lit(1.0 / spec.rate)).alias("gap_total_duration"),
        clipped.alias("clipped"),
        (short & ~clipped).alias("padded"),
        F.when(short, F.lit("boundary_repair")).otherwise(F.lit("fixed_schedule")).alias("selection_reason"),
        _stationarity(known).alias("stationarity_score"),
        F.when(F.size(known) > 0, F.sqrt(F.aggregate(known, F.lit(0.0), lambda s, x: s + x * x) / F.size(known))).alias("salience_score"),
    )
