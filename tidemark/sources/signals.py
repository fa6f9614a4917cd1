"""Sample tables: ``samples(stream_id, seq, t, v)`` from files, event tables and a synthetic generator."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Start of the driver's event table, in microseconds (fixed value).
EPOCH_US = 1_704_067_200_000_000


def events_as_samples(events: DataFrame, stream: str = "event_type", hours: bool = True) -> DataFrame:
    """Events as samples: one stream for each value of a column, time in hours (or seconds) since 2024."""
    unit = 3.6e9 if hours else 1e6
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_US)).cast("double") / F.lit(unit)
    return events.select(F.col(stream).cast("string").alias("stream_id"), F.col("event_id").alias("seq"), t.alias("t"), F.col("value").alias("v"))


def stream_id_of(stream_id: Column, source: Column, channel: Column, modality: Column, units: Column, rate: Column) -> Column:
    """The stream's id: the one given, or built from descriptors; null if those don't suffice.

    Struct of ``stream_id``, ``resolution`` (provided or derived), ``reasons``.
    """
    token = lambda c: F.nullif(F.regexp_replace(F.trim(c), r"\s+", "_"), F.lit(""))
    given = F.nullif(F.trim(stream_id), F.lit(""))
    built = F.concat_ws(":", F.lit("STR"), token(source), F.coalesce(token(channel), F.lit("ch0")), token(modality), F.coalesce(token(units), F.lit("unknown")), F.coalesce(F.nullif(F.trim(rate), F.lit("")), F.lit("na")))
    missing = F.array_compact(F.array(F.when(token(source).isNull(), F.lit("source_id")), F.when(token(modality).isNull(), F.lit("modality"))))
    ok = given.isNotNull() | (F.size(missing) == 0)
    return F.struct(
        F.when(ok, F.coalesce(given, built)).alias("stream_id"),
        F.when(given.isNotNull(), F.lit("provided")).when(ok, F.lit("derived")).alias("resolution"),
        F.when(~ok, F.lit("UNRESOLVABLE_STREAM_ID")).alias("error"),
        F.when(~ok, missing).otherwise(F.array().cast("array<string>")).alias("reasons"),
    )


def read_samples(spark: SparkSession, path: str, kind: str = "parquet", mapping: dict[str, str] | None = None, **options) -> DataFrame:
    """A whole file as samples; ``mapping`` names the columns of stream_id, seq, t and v."""
    names = {c: c for c in ("stream_id", "seq", "t", "v")} | (mapping or {})
    df = spark.read.format(kind).options(**options).load(path)
    return df.select(F.col(names["stream_id"]).cast("string").alias("stream_id"), F.col(names["seq"]).cast("long").alias("seq"), F.col(names["t"]).cast("double").alias("t"), F.col(names["v"]).cast("double").alias("v"))


class Uniform:
    """The generator of the synthetic profiles: 32-bit state, a number in [0, 1) a call."""

    def __init__(self, seed: int) -> None:
        self.state = seed & 0xFFFFFFFF

    def __call__(self) -> float:
        mask = 0xFFFFFFFF
        self.state = (self.state + 0x6D2B79F5) & mask
        x = self.state
        x = ((x ^ x >> 15) * (x | 1)) & mask
        x ^= (x + ((x ^ x >> 7) * (x | 61) & mask)) & mask
        return ((x ^ x >> 14) & mask) / 4294967296


@dataclass(frozen=True)
class Part:
    """A stretch of a profile: sine components (frequency, amplitude) from ``begin`` on; none: samples are dropped."""

    begin: float
    tones: tuple[tuple[float, float], ...] | None


BASE = ((8.0, 1.0), (20.0, 0.45))
#: Profiles of the synthetic source (fixed values): stretches, bursts' times, amplitude, width.
PROFILES: dict[str, tuple[list[Part], tuple[float, ...], float, float]] = {
    "baseline": ([Part(0, BASE), Part(3, (*BASE, (40.0, 0.65))), Part(5, ((8.0, 1.0), (24.0, 0.45))), Part(7, None), Part(7.5, BASE), Part(8, BASE)], (8.35, 8.9, 9.45), 1.2, 0.02),
    "clean": ([Part(0, ((8.0, 1.0), (20.0, 0.25))), Part(4, ((8.0, 1.0), (20.0, 0.25), (32.0, 0.18))), Part(7, ((8.0, 1.0), (20.0, 0.25)))], (), 0.0, 1.0),
    "rough": ([Part(0, BASE), Part(2, (*BASE, (40.0, 0.8))), Part(4, ((10.0, 0.9), (28.0, 0.55))), Part(6, None), Part(6.7, ((10.0, 0.9), (28.0, 0.55))), Part(7, BASE)], (7.2, 7.55, 8.1, 8.7, 9.15, 9.7), 1.5, 0.015),
}


def synthetic(profile: str = "baseline", seed: int = 42, noise: float = 0.03, seconds: float = 10.0, rate: float = 256.0) -> tuple[list[float], list[float]]:
    """Times and values of a synthetic signal."""
    parts, bursts, height, width = PROFILES[profile]
    draw = Uniform(seed)
    times, values = [], []
    for i in range(math.floor(seconds * rate)):
        t = i / rate
        tones = next(p.tones for p in reversed(parts) if t >= p.begin)
        if tones is None:
            continue
        v = sum(a * math.sin(2 * math.pi * f * t) for f, a in tones)
        if bursts and t >= parts[-1].begin:
            v += sum(height * math.exp(-((t - b) ** 2) / (2 * width * width)) for b in bursts)
        u1 = max(draw(), 1e-12)
        v += noise * math.sqrt(-2 * math.log(u1)) * math.cos(2 * math.pi * max(draw(), 1e-12))
        times.append(t)
        values.append(v)
    return times, values


def samples_of(spark: SparkSession, stream_id: str, times: list[float], values: list[float]) -> DataFrame:
    return spark.createDataFrame([(stream_id, i, t, v) for i, (t, v) in enumerate(zip(times, values, strict=True))], "stream_id string, seq long, t double, v double")
