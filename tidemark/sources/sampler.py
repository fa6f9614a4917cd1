"""The sampler's rules on sample tables: late samples, chunks, thresholds, envelopes.

The streaming form is in ``tidemark.streaming.sampler``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class SamplerError(ValueError):
    """Input that a sampler can't take: ``code`` and ``reasons``."""

    def __init__(self, code: str, *reasons: str) -> None:
        super().__init__(f"{code}: {'; '.join(reasons)}")
        self.code, self.reasons = code, list(reasons)


def config_faults(source: Column, modality: Column, rate: Column) -> Column:
    """What is wrong with a source's settings; empty if nothing."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    positive = F.coalesce((rate > 0) & ~F.isnan(rate) & (rate < float("inf")), F.lit(False))
    checks = ((blank(source), "cfg.source_id must be a non-empty string"), (blank(modality), "cfg.modality must be a non-empty string"), (~positive, "cfg.Fs_nominal must be a positive finite number"))
    return F.array_compact(F.array(*[F.when(bad, F.lit(why)) for bad, why in checks]))


def flush(samples: DataFrame, size: int | None = None) -> DataFrame:
    """What a drain of each stream's buffer gives: all samples, or the first ``size``; refused if the buffer is empty."""
    if samples.isEmpty():
        raise SamplerError("BUFFER_EMPTY", "no samples to flush")
    return samples if size is None else chunks(samples, size).where("chunk = 0").drop("chunk")


def imported(values: DataFrame, rate: float | None = None, start: float = 0.0) -> DataFrame:
    """A batch of samples from outside, with times made up at a rate if one is given; refused if it is empty."""
    if values.isEmpty():
        raise SamplerError("EMPTY_IMPORT", "no samples to import")
    return values if rate is None else synthesised(values, rate, start)


def described(samples: DataFrame, source: str, modality: str, rate: float, channel: str = "ch0", units: str | None = None, clock_policy_id: str | None = None) -> DataFrame:
    """A row a stream as the ingest step takes it: values and times in order, the source's description, a clock policy."""
    known = lambda x, kind: F.lit(x).cast(kind)
    rows = samples.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "t", "v"))).alias("x"))
    source_of = F.struct(known(source, "string").alias("source_id"), known(channel, "string").alias("channel"), known(modality, "string").alias("modality"), known(units, "string").alias("units"), known(rate, "double").alias("Fs_nominal"))
    return rows.select("stream_id", F.transform("x", lambda r: r["v"]).alias("values"), F.transform("x", lambda r: r["t"]).alias("timestamps"), source_of.alias("source"), known(clock_policy_id, "string").alias("clock_policy_id"), config_faults(F.lit(source), F.lit(modality), F.lit(float(rate))).alias("faults"))


def accepted(samples: DataFrame, allow_late: bool = False) -> DataFrame:
    """Samples with finite time and value that are later than all accepted before them."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = samples.where(finite("t") & finite("v"))
    if allow_late:
        return rows
    before = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__last", F.max("t").over(before)).where(F.col("__last").isNull() | (F.col("t") > F.col("__last"))).drop("__last")


def synthesised(values: DataFrame, rate: float, start: float = 0.0) -> DataFrame:
    """Times ``start + i / rate`` for samples without any."""
    place = F.row_number().over(Window.partitionBy("stream_id").orderBy("seq")) - 1
    return values.withColumn("t", F.lit(float(start)) + place / F.lit(float(rate)))


def ring(samples: DataFrame, capacity: int = 65_536) -> DataFrame:
    """The newest ``capacity`` samples of each stream."""
    newest = F.row_number().over(Window.partitionBy("stream_id").orderBy(F.desc("seq")))
    return samples.withColumn("__n", newest).where(F.col("__n") <= capacity).drop("__n")


def chunks(samples: DataFrame, size: int) -> DataFrame:
    """Adds ``chunk`` (from 0): successive ``size`` samples of a stream, the last one shorter."""
    place = F.row_number().over(Window.partitionBy("stream_id").orderBy("seq")) - 1
    return samples.withColumn("chunk", F.floor(place / size).cast("long"))


def chunk_summaries(samples: DataFrame, size: int) -> DataFrame:
    """What each drained chunk holds."""
    return chunks(samples, size).groupBy("stream_id", "chunk").agg(F.count(F.lit(1)).alias("samples"), F.min_by("t", "seq").alias("t_first"), F.max_by("t", "seq").alias("t_last"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))


def flushed(chunk_rows: DataFrame, condition: str, threshold: float) -> DataFrame:
    """Chunks that meet the condition; one that isn't known is never met."""
    met = {"min_samples": F.col("samples") >= threshold, "rms_above": F.col("rms") >= threshold, "rms_below": F.col("rms") < threshold}
    return chunk_rows.where(met.get(condition, F.lit(False)))


def status(samples: DataFrame, capacity: int = 65_536) -> DataFrame:
    """Buffered samples, overflow and fill of each stream's ring."""
    n = F.count(F.lit(1))
    return samples.groupBy("stream_id").agg(F.least(n, F.lit(capacity)).alias("buffered"), F.greatest(F.lit(0), n - capacity).alias("overflow"), (F.least(n, F.lit(capacity)) / F.lit(float(capacity))).alias("fill_ratio"), F.max("t").alias("last_t"))


def rms_envelope(samples: DataFrame, width: int, rate: float, source: str | None = None) -> DataFrame:
    """Root mean squares of whole, successive frames; a frame's time is its middle.  A stream shorter than a frame gives none."""
    faults = [why for bad, why in ((not isinstance(width, int) or width < 1, "rms_window_N must be a positive integer"), (not 0 < rate < float("inf"), "Fs_raw must be a positive finite number")) if bad]
    if faults:
        raise SamplerError("INVALID_CONFIG", *faults)
    rows = chunks(samples, width).groupBy("stream_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min_by("t", "seq").alias("begin"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("v"))
    out = rows.where(F.col("n") == width)
    name = F.concat_ws(":", F.lit("STR"), F.coalesce(F.lit(source), F.col("stream_id")), F.lit("ch0"), F.lit("rms_envelope"), F.lit("v1"), F.lit(f"{rate / width:g}"))
    return out.select(name.alias("stream_id"), F.col("stream_id").alias("parent"), F.col("chunk").alias("seq"), (F.col("begin") + F.lit((width / 2 - 0.5) / rate)).alias("t"), "v")
