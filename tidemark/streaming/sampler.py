"""The sampler as a stateful stream operator: late samples dropped by key, buffers drained in chunks or as sliding frames.

State of a stream: its last accepted time, how many samples it has accepted,
and a buffer shorter than a frame.  A stream's own last time decides what is
late, which is stricter than a watermark; one may still be set to expire state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import ship

STATE = "last_t double, accepted long, started long, ts array<double>, vs array<double>"
FRAMES = "stream_id string, w long, t0 double, size int, raw array<double>, last boolean"


def step(last: float | None, t: np.ndarray, v: np.ndarray) -> tuple[float | None, np.ndarray]:
    """(the new last time, which samples are accepted): finite ones later than all accepted before."""
    fine = np.isfinite(t) & np.isfinite(v)
    floor = -np.inf if last is None else last
    known = np.where(fine, t, -np.inf)
    before = np.maximum.accumulate(np.concatenate([[floor], known]))[:-1]
    kept = fine & (t > before)
    return (float(max(floor, known.max())) if len(t) and max(floor, known.max()) > -np.inf else last), kept


def _accept(size: int, hop: int, idle_ms: int | None) -> Callable:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, accepted, started, ts, vs = state.get if state.exists else (None, 0, 0, [], [])
        ts, vs = list(ts), list(vs)
        rows = [b for b in batches if len(b)]
        if rows:
            new = pd.concat(rows).sort_values("seq", kind="stable")
            t, v = new["t"].to_numpy(dtype=float), new["v"].to_numpy(dtype=float)
            last, kept = step(last, t, v)
            ts += t[kept].tolist()
            vs += v[kept].tolist()
            accepted += int(kept.sum())
        out = []
        while len(ts) >= size:
            out.append((key[0], started, ts[0], size, vs[:size], False))
            ts, vs, started = ts[hop:], vs[hop:], started + 1
        if state.hasTimedOut and ts:
            # the stream has ended, or pauses: what is left of the buffer comes out as a last, shorter frame
            out.append((key[0], started, ts[0], len(ts), vs, True))
            ts, vs, started = [], [], started + 1
        state.update((last, accepted, started, ts, vs))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["stream_id", "w", "t0", "size", "raw", "last"])

    return run


def framed(samples: DataFrame, size: int, hop: int, idle_ms: int | None = None) -> DataFrame:
    """Sliding frames (tumbling chunks where ``hop`` is ``size``) of a stream of samples, as soon as they are full.

    A key without a sample for ``idle_ms`` of processing time gives what its
    buffer still holds as a shorter frame whose ``last`` is true; null: never.
    """
    ship(samples.sparkSession)
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return samples.groupBy("stream_id").applyInPandasWithState(_accept(size, hop, idle_ms), FRAMES, STATE, "append", timeout)


def chunked(samples: DataFrame, size: int, idle_ms: int | None = None) -> DataFrame:
    return framed(samples, size, size, idle_ms)


def commit_batches(states: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that stores a batch's states whose id isn't stored yet; a repeated batch adds nothing."""
    from ..operators import graph

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        known = spark.read.schema(batch.schema).parquet(path) if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else None
        graph.commit(batch, known, "w").write.mode("append").parquet(path)

    return sink
