"""Half spectra of tapered frames, by an Arrow-batched FFT; rows with missing samples are refused."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import ship
from ..plans.policies import Transform

BIN = "struct<k:int,freq_hz:double,re:double,im:double,magnitude:double,phase:double>"


def transformable(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames without missing samples, the others with ``error``)."""
    whole = (F.size("windowed") > 0) & F.forall("windowed", lambda x: x.isNotNull() & ~F.isnan(x))
    return frames.where(whole), frames.where(~whole).withColumn("error", F.lit("NON_TRANSFORMABLE_WINDOW"))


def scale(mode: str, padded: int) -> float:
    return {"forward_1_over_N": 1 / padded, "unitary": padded**-0.5}.get(mode, 1.0)


def half_spectrum(x: np.ndarray, rate: float, mode: str) -> tuple[np.ndarray, dict]:
    """(k, freq, re, im, magnitude, phase) rows for k up to half the frame, and the receipt.  Frames are padded to a power of two."""
    n = len(x)
    padded = 1 << max(0, n - 1).bit_length()
    full = np.fft.fft(x, padded) * scale(mode, padded)
    some = full[: n // 2 + 1]
    k = np.arange(len(some))
    bins = np.stack([k, k * (rate / n), some.real, some.imag, np.hypot(some.real, some.imag), np.arctan2(some.imag, some.real)])
    power = float(np.sum(full.real**2 + full.imag**2)) * {"forward_raw": 1 / padded, "forward_1_over_N": padded}.get(mode, 1.0)
    time = float(np.sum(x * x))
    squares = bins[4] ** 2
    total, peak = squares.sum(), int(squares.argmax())
    leak = 0.0 if total == 0 else 1 - squares[max(0, peak - 1) : peak + 2].sum() / total
    return bins, {"energy_total": power, "parseval_error": 0.0 if time == 0 else abs(power - time) / max(time, 1e-12), "leakage_estimate": float(leak), "padded_length": padded}


def spectra(frames: DataFrame, rate: float, policy: Transform = Transform()) -> DataFrame:
    """Adds ``spectrum`` (array of bins) and the transform receipt to frames without missing samples."""
    if policy.transform_type not in ("fft", "dft"):
        raise ValueError(f"transform_type={policy.transform_type} not supported")
    ship(frames.sparkSession)
    whole, _ = transformable(frames)
    receipt = [("energy_total", T.DoubleType()), ("parseval_error", T.DoubleType()), ("leakage_estimate", T.DoubleType()), ("padded_length", T.IntegerType())]
    bins = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType() if c == "k" else T.DoubleType()) for c in ("k", "freq_hz", "re", "im", "magnitude", "phase")]))
    schema = T.StructType([*whole.schema.fields, T.StructField("spectrum", bins), *[T.StructField(c, t) for c, t in receipt]])
    mode = policy.normalization_mode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [half_spectrum(np.asarray(x, dtype=float), rate, mode) for x in batch.column(batch.schema.get_field_index("windowed")).to_pylist()]
            offsets = pa.array(np.concatenate([[0], np.cumsum([b.shape[1] for b, _ in done])]), pa.int32())
            flat = np.concatenate([b for b, _ in done], axis=1) if done else np.empty((6, 0))
            names = ["k", "freq_hz", "re", "im", "magnitude", "phase"]
            values = pa.StructArray.from_arrays([pa.array(flat[0].astype(np.int32)), *(pa.array(r) for r in flat[1:])], names=names)
            extra = [pa.array([r[c] for _, r in done], pa.int32() if c == "padded_length" else pa.float64()) for c, _ in receipt]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, values), *extra], names=schema.names)

    return whole.mapInArrow(run, schema)
