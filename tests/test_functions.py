from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import numbers, vectors
from tidemark.plans.policies import bench_policies
from tidemark.sources.signals import Uniform, synthetic

NUMBERS = {0.0: "0", 1.0: "1", 256.0: "256", 0.5: "0.5", 1e-7: "1e-7", 1.5e-7: "1.5e-7", 1e-6: "0.000001", 1e21: "1e+21", 1e20: "100000000000000000000", 123456789.123: "123456789.123", -2.5: "-2.5", 0.1 + 0.2: "0.30000000000000004", 1e7: "10000000"}


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("x", NUMBERS)
def test_number_text(spark, x):
    assert numbers.number_text(x) == NUMBERS[x]
    assert one(spark, numbers.number_string(F.lit(x))) == NUMBERS[x]


def test_rounding_and_scores(spark):
    assert one(spark, numbers.half_up(F.lit(-2.5))) == -2
    assert one(spark, numbers.half_up(F.lit(2.5))) == 3
    assert one(spark, numbers.threshold_score(F.lit(0.1), 0.4)) == pytest.approx(0.75)
    assert one(spark, numbers.threshold_score(F.lit(0.0), 0)) == 1.0
    assert one(spark, numbers.threshold_score(F.lit(0.1), 0)) == 0.0


@pytest.mark.parametrize("d", [0.0, math.pi, -math.pi, 3.5, -3.5, 7.0, 100.0, -100.0])
def test_wrapped_phase(spark, d):
    e = d
    while e > math.pi:
        e -= 2 * math.pi
    while e < -math.pi:
        e += 2 * math.pi
    assert one(spark, numbers.wrapped_phase(F.lit(d))) == pytest.approx(e, abs=1e-9)


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(0.5), F.lit(2.0), F.lit(3.0))
    assert one(spark, vectors.l1(a, b)) == pytest.approx(3.5)
    assert one(spark, vectors.cosine(a, a)) == pytest.approx(1.0)
    assert one(spark, vectors.cosine(a, F.array(F.lit(0.0)))) == 0.0
    assert one(spark, vectors.lower_rank(F.array(F.lit(1.0), F.lit(2.0), F.lit(10.0)), 0.95)) == 2.0
    assert one(spark, vectors.circular_spread(F.array(F.lit(0.0), F.lit(math.pi)))) == pytest.approx(math.pi)
    assert one(spark, vectors.circular_spread(F.array().cast("array<double>"))) == 0.0
    assert [one(spark, vectors.band_of(F.lit(f), [0.0, 1.0, 4.0])) for f in (0.0, 1.0, 4.0, 5.0)] == [0, 1, 1, -1]
    assert vectors.default_edges(256.0) == [0.0, 1.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0]


def test_policy_ids():
    p = bench_policies()
    assert p.compression.id() == "COMP:pid=compress.synthetic.v1:select=topK:budget=8:maxK=8:lens=identity:recon=0.25:energy=0.25:band=0.3:dc=true:novelty=true:numeric=tolerant"
    assert p.grid.id(0.0) == "GRID:Fs=256:tref=0:grid=strict:drift=none:nonmono=reject:interp=linear:gap=interpolate_small:smallgap=3:maxgap=null:aa=false"
    assert p.merge.id().startswith("MERGE:pid=merge.synthetic.v1:adj=time_touching")


def test_generator():
    draw = Uniform(42)
    xs = [draw() for _ in range(1000)]
    assert all(0 <= x < 1 for x in xs) and 0.45 < sum(xs) / 1000 < 0.55
    assert len(synthetic("baseline")[0]) == 2432  # 128 of 2560 samples are dropped
    assert synthetic("rough", 1)[1] != synthetic("rough", 2)[1]


def test_hash():
    assert numbers.fnv32a("") == "811c9dc5"
    assert len(numbers.fnv32a("1360,8000,330,310")) == 8
