from __future__ import annotations

import pyarrow as pa
import pytest

from tidemark.llm.common import pick, runs


@pytest.mark.parametrize("limit", [1, 3, 10, 1000])
def test_runs_never_split_a_key(limit):
    keys = [1] * 5 + [2] + [3] * 40 + [4, 5, 6] + [7] * 3
    batches = [pa.record_batch([pa.array(keys[i : i + 4], pa.int64()), pa.array(range(i, min(i + 4, len(keys))), pa.int64())], names=["k", "v"]) for i in range(0, len(keys), 4)]
    tables = list(runs(iter([*batches, batches[0].slice(0, 0)]), ["k"], limit))
    assert [v for t in tables for v in t.column("v").to_pylist()] == list(range(len(keys)))
    seen = [set(t.column("k").to_pylist()) for t in tables]
    assert all(not a & b for i, a in enumerate(seen) for b in seen[i + 1 :])
    if limit == 1:
        assert len(tables) > 1


def test_pick_takes_the_exact_name_first(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Text int, text int, other int")
    assert tuple(pick(df, "text").first()) == (2,) and tuple(pick(df, a="OTHER").first()) == (3,)
    with pytest.raises(ValueError, match="no column"):
        pick(df, "missing")
