"""Cycles of a live session: a source gives each cycle its samples, a run is registered, written down and pruned.

A cycle's folder holds its summary, text and bundles; a receipt of each cycle
goes to a folder of its own.  Both keep the newest cycles only.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import digest
from ..sources import files, sampler, signals
from .policies import bench_policies
from .session import Session

#: The published cases: profile, seed, noise, novelty threshold (fixed values).
CASES = {"baseline": ("baseline", 42, 0.03, 0.15), "rough": ("rough", 123, 0.08, 0.08), "clean": ("clean", 42, 0.01, 0.20)}


def workbench(spark: SparkSession, root: str, cases: tuple[str, ...] = tuple(CASES)) -> DataFrame:
    """Runs published cases, each into a folder of its own with its bundle; a row a case with its counts."""
    rows = []
    for case in cases:
        profile, seed, noise, threshold = CASES[case]
        session = Session(spark, bench_policies(threshold))
        run = session.ingest(signals.samples_of(spark, case, *signals.synthetic(profile, seed, noise)), case)
        documents = [r["document"] for r in session.bundle().collect()]  # one stream
        files.write_text(spark, f"{root.rstrip('/')}/{case}/workbench.json", documents[0] + "\n")
        rows.append(run.summary.withColumn("case_name", F.lit(case)))
    return functools.reduce(DataFrame.unionByName, rows)


#: Where a cycle's samples come from (fixed values).
MODES = ("synthetic", "sampler_flush_all", "sampler_flush_chunk")


def source(spark: SparkSession, mode: str = "synthetic", stream: str = "live", seed: int = 42, noise: float = 0.03, chunk: int | None = None, profile: str = "baseline") -> Callable[[int], DataFrame]:
    """The samples of a cycle by its number: made anew, or what a sampler lets go of, all of it or its first chunk."""
    if mode not in MODES:
        raise ValueError(f"unsupported source mode {mode!r}; expected one of {', '.join(MODES)}")

    def of(cycle: int) -> DataFrame:
        made = signals.samples_of(spark, stream, *signals.synthetic(profile, seed + cycle, noise))
        if mode == "synthetic":
            return made
        kept = sampler.ring(sampler.accepted(made))
        return kept if mode == "sampler_flush_all" else sampler.chunks(kept, chunk or 1024).where("chunk = 0").drop("chunk")

    return of


def prune_cycles(spark: SparkSession, root: str, keep: int) -> list[str]:
    """Deletes all but the newest ``keep`` cycle folders; returns their names."""
    fs, top = files._fs(spark, root)
    if not fs.exists(top):
        return []
    found = sorted((int(m[1]), s.getPath()) for s in fs.listStatus(top) if s.isDirectory() and (m := re.fullmatch(r"cycle_(\d+)", s.getPath().getName())))
    gone = found[: len(found) - keep] if keep < len(found) else []
    for _, path in gone:
        fs.delete(path, True)
    return [path.getName() for _, path in gone]


def cycles(session: Session, samples: Callable[[int], DataFrame], root: str, receipts: str, number: int = 5, keep: int = 20, mode: str = "synthetic") -> Iterator[dict]:
    """Runs ``number`` cycles; gives each cycle's summary once it is written."""
    spark = session.spark
    for i in range(number):
        index = session.count + 1
        label = f"live_run_{index}"
        run = session.ingest(samples(i), label)
        latest = session.cycles().orderBy(F.desc("cycle_index")).limit(1)
        counts = run.summary.agg(F.sum("state_count").alias("state_count"), F.sum("basin_count").alias("basin_count"), F.sum("skipped_window_count").alias("skipped_windows"), F.sum("merge_failure_count").alias("merge_failures"), F.first("stream_id").alias("stream_id"))
        marks = session.signatures.orderBy(F.desc("run_idx")).limit(1).select("convergence", "motion", "occupancy", "recurrence", "continuity", "segment_count")
        rows = latest.select("state_count_changed", "convergence_changed", "recurrence_changed").join(counts).join(marks).withColumns({"cycle_index": F.lit(index), "run_label": F.lit(label), "cross_run_count": F.lit(session.count), "source_mode": F.lit(mode)})  # a row each
        row = rows.withColumn("text", digest.summary_text(rows.columns)).first().asDict()
        folder = f"{root.rstrip('/')}/cycle_{index:02d}"
        files.write_text(spark, f"{folder}/summary.json", json.dumps({k: v for k, v in row.items() if k != "text"}, indent=2))
        files.write_text(spark, f"{folder}/summary.txt", row["text"])
        session.bundle().write.mode("overwrite").json(f"{folder}/workbench")
        files.write_receipt(spark, receipts, {k: v for k, v in row.items() if k != "text"})
        prune_cycles(spark, root, keep)
        files.prune(spark, receipts, keep)
        yield row
