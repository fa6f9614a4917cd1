"""Text checks on model answers: JSON found in prose, repeated and empty lines, declared authority."""

from __future__ import annotations

import itertools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an answer must not claim, and the posture it must declare (fixed values).
REQUIRED_NON_CLAIMS = ["not canon authority.", "not runtime authority.", "not truth closure.", "not same-object closure.", "not identity closure.", "not promotion authority."]
POSTURE = {"read_side_only": True, "canon_authority": False, "runtime_authority": False, "truth_closure": False, "identity_closure": False, "same_object_closure": False, "promotion_authority": False}
USELESS = ["", "read-side observation only.", "read-side observation only"]


#: A whole string (or one that never ends), an escaped character, or a brace.
_TOKEN = re.compile(r'"(?:\\.|[^"\\])*(?:"|\\?\Z)|\\.|[{}]', re.DOTALL)
_LEVEL = {"{": 1, "}": -1}


def find_object(text: str | None) -> tuple[str | None, str, str]:
    """(the first balanced ``{...}``, the text before it, the text after it); braces in strings don't count.

    The running sum of the braces' levels is 0 for the first time where the object ends.
    """
    whole = text or ""
    tokens = list(_TOKEN.finditer(whole, whole.find("{"))) if "{" in whole else []
    levels = itertools.accumulate(_LEVEL.get(t.group(), 0) for t in tokens)
    last = next((t for t, level in zip(tokens, levels, strict=False) if not level), None)
    if last is None:
        return None, whole, ""
    return whole[tokens[0].start() : last.end()], whole[: tokens[0].start()], whole[last.end() :]


def extract_object(text: Column) -> Column:
    """Struct of ``json``, ``leading`` and ``trailing`` text, by Arrow batches."""

    @F.pandas_udf("json string, leading string, trailing string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([find_object(x) for x in s], columns=["json", "leading", "trailing"])

    return run(text)


def _plain(values: Column) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.lower(F.trim(F.coalesce(x, F.lit("")))))


def duplicates(values: Column) -> Column:
    """How many texts repeat an earlier one, whatever their case; empty ones don't count."""
    some = F.filter(_plain(values), lambda x: x != "")
    return F.size(some) - F.size(F.array_distinct(some))


def useless(values: Column) -> Column:
    """How many texts are empty or say nothing."""
    return F.size(F.filter(_plain(values), lambda x: x.isin(USELESS)))


def authority_drift(posture: Column) -> Column:
    """How many of the seven declarations of a JSON object differ from what they must be; all where it is none."""
    off = [F.when(F.get_json_object(posture, f"$.{k}") == str(v).lower(), 0).otherwise(1) for k, v in POSTURE.items()]
    return F.when(F.coalesce(F.trim(posture).startswith("{"), F.lit(False)), sum(off[1:], off[0])).otherwise(F.lit(len(POSTURE)))


def has_non_claims(values: Column) -> Column:
    own = _plain(values)
    return F.size(F.array_except(F.array(*map(F.lit, REQUIRED_NON_CLAIMS)), own)) == 0
