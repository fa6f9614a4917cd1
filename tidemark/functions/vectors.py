"""Vector expressions over array<double> columns, all inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero() -> Column:
    return F.lit(0.0)


def total(xs: Column) -> Column:
    """The sum in the array's order; nulls count as 0."""
    return F.aggregate(xs, _zero(), lambda s, x: s + F.coalesce(x, _zero()))


def l1(a: Column, b: Column) -> Column:
    """Sum of absolute differences; the shorter vector is filled with zeros."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(F.coalesce(x, _zero()) - F.coalesce(y, _zero()))), _zero(), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x, _zero()) * F.coalesce(y, _zero())), _zero(), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    na, nb = dot(a, a), dot(b, b)
    return F.when((na == 0) | (nb == 0), _zero()).otherwise(dot(a, b) / F.sqrt(na * nb))


def lower_rank(sorted_xs: Column, p: float) -> Column:
    """The element at floor(p (n - 1)) of a sorted array; null if it is empty."""
    return F.when(F.size(sorted_xs) > 0, F.element_at(sorted_xs, F.floor(F.lit(p) * (F.size(sorted_xs) - 1)).cast("int") + 1))


def energy(bins: Column) -> Column:
    """Sum of squared magnitudes of an array of structs with ``re`` and ``im``."""
    return F.aggregate(bins, _zero(), lambda s, b: s + b["re"] * b["re"] + b["im"] * b["im"])


def band_of(freq: Column, edges: list[float]) -> Column:
    """The band [lo, hi) of a frequency, the last edge belonging to the last band; -1 outside."""
    out = F.lit(-1)
    for i in reversed(range(len(edges) - 1)):
        out = F.when((freq >= edges[i]) & (freq < edges[i + 1]), F.lit(i)).otherwise(out)
    return F.when((freq == edges[-1]) & (out == -1), F.lit(len(edges) - 2)).otherwise(out)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def by_band(bins: Column, edges: list[float], what: Callable[[Column], Column], use: Callable[[Column], Column]) -> Column:
    """For each band ``use`` of the array of ``what`` of its bins."""
    tagged = F.transform(bins, lambda b: F.struct(band_of(b["freq_hz"], edges).alias("band"), what(b).alias("x")))
    bands = F.sequence(F.lit(0), F.lit(len(edges) - 2))
    return bound(tagged, lambda t: F.transform(bands, lambda i: use(F.transform(F.filter(t, lambda x: x["band"] == i), lambda x: x["x"]))))


def band_profile(bins: Column, edges: list[float]) -> Column:
    """Energy by band, divided by its sum; all 0 if there is none."""
    raw = by_band(bins, edges, lambda b: b["re"] * b["re"] + b["im"] * b["im"], total)
    return bound(F.struct(raw.alias("raw"), total(raw).alias("sum")), lambda p: F.transform(p["raw"], lambda e: F.when(p["sum"] == 0, _zero()).otherwise(e / p["sum"])))


def circular_spread(phases: Column) -> Column:
    """sqrt(-2 ln R) of the mean resultant R; 0 for no phase, pi where R vanishes."""
    n = F.size(phases)
    c = total(F.transform(phases, F.cos)) / F.greatest(n, F.lit(1))
    s = total(F.transform(phases, F.sin)) / F.greatest(n, F.lit(1))
    spread = lambda r: F.when(n == 0, _zero()).when(r <= 1e-12, F.lit(math.pi)).otherwise(F.sqrt(F.lit(-2.0) * F.ln(F.least(r, F.lit(1.0)))))
    return bound(F.struct(c.alias("c"), s.alias("s")), lambda v: bound(F.sqrt(v["c"] * v["c"] + v["s"] * v["s"]), spread))


def default_edges(rate: float) -> list[float]:
    """Octave edges from 0 up to half the rate."""
    half = rate / 2
    return sorted({0.0, half} | {float(e) for e in (1, *(2**k for k in range(2, 11))) if e <= half})
