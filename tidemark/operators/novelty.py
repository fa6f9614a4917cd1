"""Novelty of states against a baseline, and the segmentation it drives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import ship
from ..functions.numbers import wrapped_phase
from ..functions.vectors import l1
from ..plans.policies import Anomaly
from .components import written

EVENT = "array<struct<type:string,freq_hz:double,magnitude_delta:double,phase_delta:double,band_id:int>>"


def align_bins(current: Column, base: Column, tolerance: float) -> Column:
    """Struct of ``matched`` (pairs), ``current_only`` and ``base_only`` bins.

    Equal k match first come; a bin without one takes the first base bin
    within the tolerance that no earlier bin took.
    """
    bins = lambda xs: F.array_sort(xs, lambda a, b: a["k"] - b["k"])
    cur, bas = bins(current), bins(base)
    if tolerance <= 0:
        mine, theirs = F.transform(cur, lambda b: b["k"]), F.transform(bas, lambda b: b["k"])
        matched = F.transform(F.filter(cur, lambda b: F.array_contains(theirs, b["k"])), lambda b: F.struct(b.alias("current"), F.element_at(F.filter(bas, lambda o: o["k"] == b["k"]), 1).alias("base")))
        return F.struct(matched.alias("matched"), F.filter(cur, lambda b: ~F.array_contains(theirs, b["k"])).alias("current_only"), F.filter(bas, lambda b: ~F.array_contains(mine, b["k"])).alias("base_only"))
    theirs = F.transform(bas, lambda b: b["k"])
    empty = F.array().cast("array<int>")
    taken = F.struct(empty.alias("used"), empty.alias("own"), empty.alias("other"))

    def step(acc: Column, b: Column) -> Column:
        near = F.filter(bas, lambda o: ~F.array_contains(acc["used"], o["k"]) & (F.abs(o["freq_hz"] - b["freq_hz"]) <= tolerance))
        found = F.when(F.array_contains(theirs, b["k"]), b["k"]).otherwise(F.try_element_at(near, F.lit(1))["k"]).cast("int")
        one = lambda x: F.array(x.cast("int"))
        grown = F.struct(F.concat(acc["used"], one(found)).alias("used"), F.concat(acc["own"], one(b["k"])).alias("own"), F.concat(acc["other"], one(found)).alias("other"))
        return F.when(found.isNotNull(), grown).otherwise(acc)

    done = F.aggregate(cur, taken, step)
    pick = lambda xs, k: F.element_at(F.filter(xs, lambda o: o["k"] == k), 1)
    matched = F.zip_with(done["own"], done["other"], lambda a, b: F.struct(pick(cur, a).alias("current"), pick(bas, b).alias("base")))
    return F.struct(matched.alias("matched"), F.filter(cur, lambda b: ~F.array_contains(done["own"], b["k"])).alias("current_only"), F.filter(bas, lambda b: ~F.array_contains(done["used"], b["k"])).alias("base_only"))


def divergence(policy: Anomaly, matched: Column, energy: Column, base_energy: Column, profile: Column, base_profile: Column) -> Column:
    if policy.invariance_mode == "structural" or policy.divergence_metric == "l2_complex":
        square = lambda x: x * x
        apart = F.aggregate(matched, F.lit(0.0), lambda s, p: s + square(p["current"]["re"] - p["base"]["re"]) + square(p["current"]["im"] - p["base"]["im"]))
        power = F.aggregate(matched, F.lit(0.0), lambda s, p: s + square(p["base"]["re"]) + square(p["base"]["im"]))
        return F.when(F.size(matched) == 0, F.lit(1.0)).otherwise(F.sqrt(apart / F.greatest(power, F.lit(1e-12))))
    if policy.invariance_mode == "energy" or policy.divergence_metric == "energy_delta":
        return F.abs(energy - base_energy) / F.greatest(F.abs(base_energy), F.lit(1e-12))
    return l1(profile, base_profile)


def events(policy: Anomaly, match: Column, profile: Column, base_profile: Column) -> Column:
    """New and vanished frequencies, drifts of matched bins, energy shifts of bands."""
    none, nowhere = F.lit(None).cast("double"), F.lit(None).cast("int")
    event = lambda kind, freq, size, phase, band: F.struct(F.lit(kind).alias("type"), freq.alias("freq_hz"), size.alias("magnitude_delta"), phase.alias("phase_delta"), band.alias("band_id"))
    new = F.transform(F.filter(match["current_only"], lambda b: b["magnitude"] >= policy.new_frequency_threshold), lambda b: event("new_frequency", b["freq_hz"], b["magnitude"], none, nowhere))
    lost = F.transform(F.filter(match["base_only"], lambda b: b["magnitude"] >= policy.vanished_frequency_threshold), lambda b: event("vanished_frequency", b["freq_hz"], -b["magnitude"], none, nowhere))
    turn = lambda p: wrapped_phase(p["current"]["phase"] - p["base"]["phase"])
    strong = F.filter(match["matched"], lambda p: (F.greatest(p["current"]["magnitude"], p["base"]["magnitude"]) >= policy.dominant_bin_threshold) & (F.abs(turn(p)) > 0))
    drifts = F.transform(strong, lambda p: event("drift", p["current"]["freq_hz"], p["current"]["magnitude"] - p["base"]["magnitude"], turn(p), nowhere))
    bands = F.transform(F.zip_with(profile, base_profile, lambda a, b: a - b), lambda d, i: event("energy_shift", none, d, none, i))
    shifts = F.filter(bands, lambda e: e["magnitude_delta"].isNotNull() & (F.abs(e["magnitude_delta"]) >= policy.energy_shift_threshold))
    parts = [new, lost, *([] if policy.phase_sensitivity_mode == "off" else [drifts]), shifts]
    return F.concat(*parts)


def compare(pairs: DataFrame, policy: Anomaly = Anomaly()) -> DataFrame:
    """Reports for rows with ``current`` and ``base`` states (structs); ``error`` where they can't be compared."""
    c, b = F.col("current"), F.col("base")
    other_stream, other_grid = c["stream_id"] != b["stream_id"], (c["rate"] != b["rate"]) | (c["size"] != b["size"]) | (c["df"] != b["df"])
    match = align_bins(c["kept_bins"], b["kept_bins"], policy.frequency_tolerance_hz)
    duration = c["t_end"] - c["t_start"]
    rows = pairs.withColumn("match", match)
    rows = rows.withColumn("divergence_score", divergence(policy, F.col("match.matched"), c["energy_raw"], b["energy_raw"], c["profile"], b["profile"]))
    rows = rows.withColumn("detected_events", events(policy, F.col("match"), c["profile"], b["profile"]))
    above = F.col("divergence_score") > policy.threshold_value
    gate = above & (duration >= policy.novelty_min_duration)
    rows = rows.withColumn("novelty_gate_triggered", gate)
    posture = (
        F.when(F.col("novelty_gate_triggered"), F.lit("above_threshold | segmentation pressure registered"))
        .when(above, F.lit("above_threshold | duration_insufficient_for_novelty_gate"))
        .when((F.size("detected_events") > 0) | (F.col("divergence_score") > 0), F.lit("below_or_equal_threshold | deviation observed without novelty closure"))
        .otherwise(F.lit("below_or_equal_threshold | no material deviation closure"))
    )
    strict = F.col("novelty_gate_triggered") & F.lit(policy.segmentation_mode == "strict")
    return rows.withColumns(
        {
            "bins_compared": F.size("match.matched"),
            "threshold_relation": F.when(above, F.lit("above_threshold")).otherwise(F.lit("below_or_equal_threshold")),
            "threshold_posture": posture,
            "segmentation_recommendation": F.when(strict, F.lit("new_segment")).otherwise(F.lit("continue_segment")),
            "error": F.when(other_stream, F.lit("BASELINE_SCOPE_MISMATCH")).when(other_grid, F.lit("GRID_MISMATCH")),
        }
    ).drop("match")


def _matched(current: list[dict], base: list[dict], tolerance: float) -> list[tuple[dict, dict]]:
    """Pairs of bins as ``align_bins`` matches them."""
    cur, bas = (sorted(x, key=lambda b: b["k"]) for x in (current, base))
    by_k, used, out = {b["k"]: b for b in reversed(bas)}, set(), []
    for b in cur:
        other = by_k.get(b["k"])
        if other is None and tolerance > 0:
            other = next((o for o in bas if o["k"] not in used and abs(o["freq_hz"] - b["freq_hz"]) <= tolerance), None)
        if other is not None:
            used.add(other["k"])
            out.append((b, other))
    return out


def _apart(policy: Anomaly) -> tuple[str, Callable]:
    """(the column that the fold compares, how far two of its values are apart), as ``divergence`` has it."""
    if policy.invariance_mode == "structural" or policy.divergence_metric == "l2_complex":

        def bins(x: list[dict], y: list[dict]) -> float:
            pairs = _matched(x, y, policy.frequency_tolerance_hz)
            moved = sum((a["re"] - b["re"]) ** 2 + (a["im"] - b["im"]) ** 2 for a, b in pairs)
            power = sum(b["re"] ** 2 + b["im"] ** 2 for _, b in pairs)
            return (moved / max(power, 1e-12)) ** 0.5 if pairs else 1.0

        return "kept_bins", bins
    if policy.invariance_mode == "energy" or policy.divergence_metric == "energy_delta":
        return "energy_raw", lambda x, y: abs(x - y) / max(abs(y), 1e-12)

    def profiles(x: list[float], y: list[float]) -> float:
        width = max(len(x), len(y))
        return float(sum(abs(a - b) for a, b in zip([*x, *[0.0] * (width - len(x))], [*y, *[0.0] * (width - len(y))], strict=True)))

    return "profile", profiles


def segments(states: DataFrame, policy: Anomaly = Anomaly(), carried: DataFrame | None = None) -> DataFrame:
    """Adds ``epoch``, ``segment_id``, ``base_w`` (null for a baseline), ``divergence`` and ``novelty``.

    A stream's states are read in order by one task that holds no more than
    the baseline: the first state of a segment is its baseline, and one that
    triggers the gate still belongs to the old segment.  Only what the fold
    compares goes through it; the rest of a state is joined back.

    ``carried`` continues earlier tables: a row a stream as ``baselines`` gives it.

    Inputs: a state without what is compared (null, or a list that holds null) is no baseline and
    triggers nothing, its ``base_w`` and ``divergence`` being null; rows with a
    null ``stream_id`` are a stream of their own; an empty table gives an empty one.
    """
    what, apart = _apart(policy)
    spark = states.sparkSession
    ship(spark)
    kind = states.schema[what].dataType
    states = written(states.withColumn("__row", F.monotonically_increasing_id()))
    narrow = states.select("__row", "stream_id", F.col("w").cast("long").alias("w"), "t_start", "t_end", what, F.lit(None).cast("long").alias("epoch"), F.lit(1).alias("__kind"))
    if carried is not None:
        before = carried.select(F.lit(None).cast("long").alias("__row"), "stream_id", F.col("w").cast("long").alias("w"), "t_start", "t_end", F.col(what).cast(kind).alias(what), "epoch", F.lit(0).alias("__kind"))
        narrow = narrow.unionByName(before)
    threshold, least = policy.threshold_value, policy.novelty_min_duration

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, epoch, base = object(), 0, None
        for batch in batches:
            out: list[tuple] = []
            for row, s, w, a, z, x, known, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != stream:
                    stream, epoch, base = s, 0, None
                usable = x is not None and not (isinstance(x, list) and None in x)
                if row is None:  # what an earlier table left: its epoch, and the baseline if there is one
                    epoch, base = known, (w, x) if usable else None
                elif not usable:
                    out.append((row, epoch, None, None, False))
                elif base is None:
                    base = (w, x)
                    out.append((row, epoch, None, None, False))
                else:
                    d = apart(x, base[1])
                    new = d > threshold and a is not None and z is not None and z - a >= least
                    out.append((row, epoch, base[0], d, new))
                    if new:
                        epoch, base = epoch + 1, None
            columns = list(zip(*out, strict=True)) if out else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()), strict=True)], names=["__row", "epoch", "base_w", "divergence", "novelty"])

    ordered = narrow.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "stream_id").sortWithinPartitions("stream_id", "__kind", "w")
    folded = ordered.mapInArrow(run, "__row long, epoch long, base_w long, divergence double, novelty boolean")
    return states.join(folded, "__row").drop("__row").withColumn("segment_id", F.concat(F.lit("seg:"), F.col("stream_id"), F.lit(":"), F.col("epoch").cast("string")))


def baselines(segmented: DataFrame, policy: Anomaly = Anomaly(), carried: DataFrame | None = None) -> DataFrame:
    """A row a stream: where its fold stands after these states, for ``segments`` to go on from."""
    what, _ = _apart(policy)
    key = ["stream_id", "w", "t_start", "t_end", what, "epoch"]
    order = Window.partitionBy("stream_id").orderBy(F.desc("w"))
    last = segmented.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    # after a state that triggered the gate the next segment is open and has no baseline yet
    opened = last.where("novelty").withColumns({"epoch": F.col("epoch") + 1, what: F.lit(None).cast(segmented.schema[what].dataType)}).select(*key)
    rest = last.where("not novelty").select("stream_id", F.col("epoch").alias("__epoch"))
    first = segmented.where(F.col("base_w").isNull() & F.col(what).isNotNull()).groupBy("stream_id", "epoch").agg(F.min_by(F.struct(*key), "w").alias("b")).select("b.*")
    kept = first.join(rest.withColumnRenamed("stream_id", "__s"), F.col("stream_id").eqNullSafe(F.col("__s")) & (F.col("epoch") == F.col("__epoch")), "right")
    own = kept.where("epoch is not null").select(*key)
    waiting = kept.where("epoch is null").select(F.col("__s").alias("stream_id"), F.col("__epoch").alias("epoch"))
    if carried is None:
        none = segmented.schema
        return opened.unionByName(own).unionByName(waiting.select("stream_id", *[F.lit(None).cast(none[c].dataType).alias(c) for c in key[1:5]], "epoch"))
    # a segment that goes on keeps its baseline, and a stream without new states its place
    old = carried.select(*key)
    going = old.join(waiting.select(F.col("stream_id").alias("__s")), F.col("stream_id").eqNullSafe(F.col("__s")), "left_semi")
    quiet = old.join(last.select(F.col("stream_id").alias("__s")), F.col("stream_id").eqNullSafe(F.col("__s")), "left_anti")
    return opened.unionByName(own).unionByName(going).unionByName(quiet)


def transitions(segmented: DataFrame) -> DataFrame:
    """One row a segment boundary."""
    step = lambda n: F.concat(F.lit("seg:"), F.col("stream_id"), F.lit(":"), (F.col("epoch") + n).cast("string"))
    return segmented.where("novelty").select("stream_id", step(0).alias("from_segment_id"), step(1).alias("to_segment_id"), F.col("t_start").alias("t_transition"), F.col("divergence").alias("divergence_score"), (F.col("epoch") + 1).alias("epoch_counter"))
