"""Scalar expressions whose rounding and text forms are fixed by the data model.

Ids embed numbers in their shortest decimal form, without a trailing ``.0``
and with plain digits between 1e-7 and 1e21; halves round up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import bound


def number_text(x) -> str:
    """A Python number, boolean or None as ids write it."""
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, str):
        return x
    x = float(x)
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    sign, x = ("-" if x < 0 else ""), abs(x)
    mantissa, exponent = f"{x!r}e0".split("e")[:2] if "e" in repr(x) else (repr(x), "0")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(exponent) - (len(whole + part) - len((whole + part).lstrip("0")))
    digits = digits.rstrip("0")
    if 0 < point <= 21:
        body = digits.ljust(point, "0") if len(digits) <= point else digits[:point] + "." + digits[point:]
    elif -6 < point <= 0:
        body = "0." + "0" * -point + digits
    else:
        e = point - 1
        body = digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + ("e+" if e > 0 else "e-") + str(abs(e))
    return sign + body


def number_string(x: Column) -> Column:
    """``number_text`` of a double column, in column functions."""
    plain = F.abs(x).cast("string")
    split = F.struct(F.substring_index(plain, "E", 1).alias("mantissa"), F.when(F.instr(plain, "E") > 0, F.substring_index(plain, "E", -1).cast("int")).otherwise(F.lit(0)).alias("exponent"))

    def digits_of(p: Column) -> Column:
        whole, joined = F.substring_index(p["mantissa"], ".", 1), F.replace(p["mantissa"], F.lit("."), F.lit(""))
        return bound(F.struct(joined.alias("j"), F.ltrim(joined, F.lit("0")).alias("b")), lambda d: F.struct(F.rtrim(d["b"], F.lit("0")).alias("digits"), (F.length(whole) + p["exponent"] - F.length(d["j"]) + F.length(d["b"])).alias("point")))

    def body(d: Column) -> Column:
        digits, point = d["digits"], d["point"]
        size = F.length(digits)
        long = F.when(size <= point, F.rpad(digits, point, "0")).otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, size)))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
        head = F.concat(F.substring(digits, 1, 1), F.when(size > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), size))).otherwise(F.lit("")))
        wide = F.concat(head, F.when(point > 1, F.lit("e+")).otherwise(F.lit("e-")), F.abs(point - 1).cast("string"))
        return F.when((point > 0) & (point <= 21), long).when((point > -6) & (point <= 0), small).otherwise(wide)

    text = bound(bound(split, digits_of), body)
    return (
        F.when(x.isNull(), F.lit("null"))
        .when(F.isnan(x), F.lit("NaN"))
        .when(F.abs(x) == float("inf"), F.when(x > 0, F.lit("Infinity")).otherwise(F.lit("-Infinity")))
        .when(x == 0, F.lit("0"))
        .otherwise(F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), text))
    )


def half_up(x: Column) -> Column:
    """To the nearest integer, halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def threshold_score(value: Column, most: Column | float) -> Column:
    """1 - value / most, between 0 and 1; a bound of 0 or less is met by values of 0 or less."""
    most = most if isinstance(most, Column) else F.lit(float(most))
    return F.when(most <= 0, F.when(value <= 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(clamp(F.lit(1.0) - value / most))


def wrapped_phase(delta: Column) -> Column:
    """A phase difference brought into [-pi, pi]; both ends stay as they are."""
    turns = F.lit(2 * math.pi)
    inside = delta - turns * F.floor((delta + F.lit(math.pi)) / turns)
    return F.when(F.abs(delta) <= math.pi, delta).when((delta > 0) & (inside == -math.pi), F.lit(math.pi)).otherwise(inside)


def grid_start(first: Column, reference: Column, rate: Column | float) -> Column:
    """The first grid time, counted from ``reference``, at or after ``first``."""
    step = F.lit(1.0) / (rate if isinstance(rate, Column) else F.lit(float(rate)))
    return reference + F.ceil((first - reference) / step) * step


def hann(n: Column, size: Column) -> Column:
    return F.when(size == 1, F.lit(1.0)).otherwise(F.lit(0.5) * (F.lit(1.0) - F.cos(F.lit(2 * math.pi) * n / (size - 1))))


def taper(name: str, n: Column, size: Column) -> Column:
    """A window function's weight at ``n`` of ``size``; names that aren't known mean Hann."""
    turn = F.lit(2 * math.pi) * n / (size - 1)
    if name == "rectangular":
        return F.lit(1.0)
    if name == "hamming":
        return F.when(size == 1, F.lit(1.0)).otherwise(F.lit(0.54) - F.lit(0.46) * F.cos(turn))
    if name == "blackman":
        return F.when(size == 1, F.lit(1.0)).otherwise(F.lit(0.42) - F.lit(0.5) * F.cos(turn) + F.lit(0.08) * F.cos(F.lit(4 * math.pi) * n / (size - 1)))
    return hann(n, size)


def hann_compensated(value: Column, n: Column, size: Column) -> Column:
    return value / F.greatest(hann(n, size), F.lit(1e-6))


def fnv32a(text: str) -> str:
    """FNV-1a of a text in 8 hex digits, with the product taken in double precision as the ids have it."""
    h = 0x811C9DC5
    for c in text:
        h = int(float(h ^ ord(c)) * float(0x01000193)) % (1 << 32)
    return f"{h:08x}"
