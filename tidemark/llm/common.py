"""What the operators share: safe column selection, cut lineage, grouped runs of Arrow rows."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from ..operators.components import discard, written

__all__ = ["cut", "discard", "lean", "partitions", "pick", "place", "prepare", "runs", "share_of", "size_of"]

WORD = r"[^\x20\x09-\x0D]+"

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Texts are long: an Arrow batch of Spark's usual 10,000 of them takes far more memory than it saves time.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Ships the package, and sets the batch size for a session that hasn't set its own."""
    ship(spark)
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_ROWS))


def place(have: list[str], name: str) -> int:
    """Where a column is: by exact name first, then without regard to case."""
    where = [i for i, c in enumerate(have) if c == name] or [i for i, c in enumerate(have) if c.lower() == name.lower()]
    if not where:
        raise ValueError(f"no column {name!r} among {have}")
    return where[0]


def pick(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """The named columns only, found by exact name first and then without regard to case.

    Extra columns, also ones whose names differ by case alone or occur twice,
    never reach the operators.
    """
    prepare(df.sparkSession)
    have = df.columns
    safe = df.toDF(*[f"__c{i}" for i in range(len(have))])
    return safe.select(*[F.col(f"__c{place(have, old)}").alias(new) for new, old in [*((n, n) for n in names), *renamed.items()]])


#: Writes the rows to a table in the shared folder and reads it back: its lineage ends there.
cut = written


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def share_of(column) -> F.Column:
    """A number in [0, 1) from a column's hash: rows below a rate are a sample of that rate, the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(column), 11) / F.lit(float(1 << 53))


def size_of(text) -> F.Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def runs(batches: Iterator[pa.RecordBatch], key: list[str], limit: int) -> Iterator[pa.Table]:
    """Regroups rows that arrive sorted by ``key`` into tables of about ``limit`` rows that never split a key's run."""
    held: list[pa.RecordBatch] = []
    rows, enough = 0, limit
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < enough:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = table.slice(rows - 1)
        same = np.ones(rows, dtype=bool)
        for k in key:
            column = table.column(k)
            same &= pc.equal(column, last.column(k)[0]).to_numpy()
        cutoff = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cutoff:
            yield table.slice(0, cutoff)
            table = table.slice(cutoff)
        held, rows = table.to_batches(), table.num_rows
        # a key with more rows than that: look again once they have doubled
        enough = limit if cutoff else 2 * rows
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a Python worker that goes on to other tasks: it keeps no memory that the task has freed."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _trim()

    return wrapped
