"""What an operator asks of its input before it runs, as columns: the first reason why a row can't be taken."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

FROM_CLOCK = ("clock_policy_id", "grid_policy_id", "window_policy_id", "transform_policy_id", "compression_policy_id")


@dataclass(frozen=True)
class Guard:
    """The error's code, what the text calls the row, and the policies that it must refer to, in the order in which they are looked for."""

    code: str
    subject: str
    ids: tuple[str, ...]
    text: str = "{subject}.policies.{id} must be a valid policy reference"


#: What each operator's input must refer to (fixed values).
GUARDS = {
    "transform": Guard("INVALID_W1", "W1", FROM_CLOCK[:3]),
    "compress": Guard("INVALID_S1", "S1", FROM_CLOCK[:4]),
    "anomaly_current": Guard("INVALID_H_CURRENT", "H_current", FROM_CLOCK),
    "anomaly_base": Guard("INVALID_H_BASE", "H_base", FROM_CLOCK),
    "merge": Guard("INVALID_INPUT_STATE", "", FROM_CLOCK, "all inputs must have valid policies.{id}"),
    "replay": Guard("INVALID_STATE", "state", ("compression_policy_id", *FROM_CLOCK[:4])),
}


def fault(name: str, columns: list[str]) -> Column:
    """Struct of ``error`` and ``reason``, null if the row has all that the operator asks for; a column that the table lacks counts as null."""
    guard = GUARDS[name]
    text = lambda c: F.col(c).cast("string") if c in columns else F.lit(None).cast("string")
    number = lambda c: F.col(c).cast("double") if c in columns else F.lit(None).cast("double")
    checks: list[tuple[Column, str]] = []
    if name == "replay":
        rate, size, start = number("rate"), number("size"), number("t_start")
        finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
        empty = F.coalesce(F.size("kept_bins") <= 0, F.lit(True)) if "kept_bins" in columns else F.lit(True)
        checks += [
            (empty, "state.kept_bins must be a non-empty array"),
            (~(finite(rate) & (rate > 0)), "state.grid.Fs_target must be a positive finite number"),
            (~(finite(size) & (size > 0) & (size == F.floor(size))), "state.grid.N must be a positive integer"),
            (~finite(start), "state must provide window_span.t_start or policy.t0_override"),
        ]
    checks += [(F.coalesce(text(i) == "", F.lit(True)), guard.text.format(subject=guard.subject, id=i)) for i in guard.ids]
    if name == "replay":
        checks.append((F.coalesce(text("artifact_class") == "M1", F.lit(False)) & F.coalesce(text("merge_policy_id") == "", F.lit(True)), "M1 replay requires state.policies.merge_policy_id"))
    reason = F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(why)) for bad, why in checks])
    return F.when(reason.isNotNull(), F.struct(F.lit(guard.code).alias("error"), reason.alias("reason")))
