"""Read-only queries over states: similarity, band lookup, energy trend, comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, l1
from ..plans.policies import Query
from .components import written


class QueryError(ValueError):
    """A query that can't be answered: ``code`` and ``reasons``."""

    def __init__(self, code: str, *reasons: str) -> None:
        super().__init__(f"{code}: {'; '.join(reasons)}")
        self.code, self.reasons = code, list(reasons)


@dataclass(frozen=True)
class Scope:
    stream_id: str | None = None
    stream_group: tuple[str, ...] | None = None
    time_range: tuple[float, float] | None = None
    allowed_segment_ids: tuple[str, ...] | None = None
    allow_cross_segment: bool = False
    same_grid_only: bool = True

    def filters(self) -> list[str]:
        named = (("same_grid", self.same_grid_only), ("same_era", not self.allow_cross_segment), ("stream_id", bool(self.stream_id)), ("time_range", bool(self.time_range)))
        return [name for name, used in named if used]


def scoped(states: DataFrame, scope: Scope, check: bool = True) -> DataFrame:
    """States in scope; refused if they span segments and the scope forbids it."""
    out = states
    if scope.stream_id:
        out = out.where(F.col("stream_id") == scope.stream_id)
    if scope.stream_group is not None:
        out = out.where(F.col("stream_id").isin(list(scope.stream_group)))
    if scope.time_range:
        begin, end = scope.time_range
        out = out.where((F.col("t_end") > begin) & (F.col("t_start") < end))
    if scope.allowed_segment_ids is not None:
        out = out.where(F.col("segment_id").isin(list(scope.allowed_segment_ids)))
    if check and not scope.allow_cross_segment and out.select("segment_id").distinct().limit(2).count() > 1:
        raise QueryError("INVALID_SCOPE", "query crosses segment boundaries but allow_cross_segment=false")
    return out


#: What is wrong with a corpus entry, in the order in which it is looked for (fixed texts).
FAULTS = ("all corpus entries must have valid state_id", "all corpus entries must have valid stream_id", "all corpus entries must have valid segment_id", "all corpus entries must have valid window_span", "all corpus entries must have valid grid", "all corpus entries must have kept_bins[]")


def corpus_fault(columns: list[str]) -> Column:
    """The first fault of a corpus entry, null if it has none; a column that the table lacks counts as null."""
    col = lambda c, kind="string": F.col(c) if c in columns else F.lit(None).cast(kind)
    blank = lambda c: F.coalesce(col(c) == "", F.lit(True))
    odd = lambda c: F.coalesce(F.isnan(col(c, "double")) | (F.abs(col(c, "double")) == float("inf")), F.lit(True))
    checks = (blank("state_id"), blank("stream_id"), blank("segment_id"), odd("t_start") | odd("t_end"), odd("rate") | odd("size"), col("kept_bins", "array<int>").isNull())
    return F.coalesce(*[F.when(bad, F.lit(why)) for bad, why in zip(checks, FAULTS, strict=True)])


def checked(states: DataFrame) -> DataFrame:
    """The corpus, refused if an entry has a fault."""
    found = {r[0] for r in states.select(corpus_fault(states.columns).alias("f")).where("f is not null").distinct().collect()}  # six texts at most
    if found:
        raise QueryError("INVALID_CORPUS", next(why for why in FAULTS if why in found))
    return states


def corpus(states: DataFrame, segment_id: str | None = None, stream_id: str | None = None, artifact_class: str | None = None) -> DataFrame:
    """Committed states that a query looks at; refused if there is none."""
    for column, wanted in (("segment_id", segment_id), ("stream_id", stream_id), ("artifact_class", artifact_class)):
        if wanted is not None:
            states = states.where(F.col(column) == wanted)
    if states.isEmpty():
        raise QueryError("EMPTY_CORPUS", "no committed states match the query opts filters")
    return states


def complex_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two sparse spectra, frequencies that one lacks counting as 0."""
    square = lambda x: x * x
    of = lambda bins, k, c: F.coalesce(F.try_element_at(F.filter(bins, lambda o: o["k"] == k), F.lit(1))[c], F.lit(0.0))
    ks = F.array_sort(F.array_union(F.transform(a, lambda x: x["k"]), F.transform(b, lambda x: x["k"])))
    return F.sqrt(F.aggregate(ks, F.lit(0.0), lambda s, k: s + square(of(a, k, "re") - of(b, k, "re")) + square(of(a, k, "im") - of(b, k, "im"))))


def complex_cosine(a: Column, b: Column) -> Column:
    """Cosine of two sparse spectra as real vectors."""
    of = lambda bins, k, c: F.coalesce(F.try_element_at(F.filter(bins, lambda o: o["k"] == k), F.lit(1))[c], F.lit(0.0))
    norm = lambda x: F.aggregate(x, F.lit(0.0), lambda s, o: s + o["re"] * o["re"] + o["im"] * o["im"])
    inner = F.aggregate(a, F.lit(0.0), lambda s, o: s + o["re"] * of(b, o["k"], "re") + o["im"] * of(b, o["k"], "im"))
    return F.when((norm(a) == 0) | (norm(b) == 0), F.lit(0.0)).otherwise(inner / F.sqrt(norm(a) * norm(b)))


def energy_gap(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-12))


def score(mode: str, policy: Query, a: Column, b: Column) -> Column:
    """How alike two states (structs) are; a scoring that the mode doesn't know means cosine."""
    if mode == "IDENTITY":
        return F.lit(1.0) / (F.lit(1.0) + complex_distance(a["kept_bins"], b["kept_bins"])) if policy.scoring == "l2_complex" else complex_cosine(a["kept_bins"], b["kept_bins"])
    if mode == "ENERGY" and policy.scoring == "energy_delta":
        return F.lit(1.0) - F.least(F.lit(1.0), energy_gap(a["energy_raw"], b["energy_raw"]))
    if mode != "ENERGY" and policy.scoring == "band_l1":
        return F.lit(1.0) / (F.lit(1.0) + l1(a["profile"], b["profile"]))
    return cosine(a["profile"], b["profile"])


def explanation(mode: str, policy: Query, a: Column, b: Column) -> Column:
    if mode == "IDENTITY":
        return F.struct(F.lit(policy.scoring).alias("metric"), F.lit(policy.phase_used).alias("phase_used"), complex_distance(a["kept_bins"], b["kept_bins"]).alias("complex_distance"))
    if mode == "ENERGY":
        return F.struct(F.lit(policy.scoring).alias("metric"), a["energy_raw"].alias("energy_a"), b["energy_raw"].alias("energy_b"), energy_gap(a["energy_raw"], b["energy_raw"]).alias("energy_delta_rel"))
    return F.struct(F.lit(policy.scoring).alias("metric"), l1(a["profile"], b["profile"]).alias("band_profile_l1"))


def _ranked(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """Ranks from 1; the list is cut before it is numbered, so only its rows are sorted in one place."""
    return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Ranks of all rows, ascending: dealt to ranges, numbered inside each, and moved on by the rows of the ranges before."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    first = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__at", inside).join(F.broadcast(first), "__range").withColumn("rank", (F.col("__first") + F.col("__at")).cast("int")).drop("__range", "__first", "__at")


_ITEM = ("ref", "score", "artifact_class", "stream_id", "segment_id", "t_start", "t_end", "explain")


def similarity(states: DataFrame, query: DataFrame | None, scope: Scope, mode: str, policy: Query, check: bool = True, waveform: DataFrame | None = None) -> DataFrame:
    """The states most like the one state of ``query``; a waveform must have been made a state before."""
    if query is None:
        raise QueryError("INVALID_QUERY", "a waveform must be transformed to a state first" if waveform is not None else "a similarity query requires a state or a waveform")
    corpus = scoped(states, scope, check)
    one = query.limit(1).select(F.struct(*query.columns).alias("q"))
    rows = corpus.select(F.struct(*corpus.columns).alias("s")).join(F.broadcast(one))  # one row, by construction
    if scope.same_grid_only:
        rows = rows.where((F.col("q.rate") == F.col("s.rate")) & (F.col("q.size") == F.col("s.size")) & (F.col("q.df") == F.col("s.df")))
    q, s = F.col("q"), F.col("s")
    rows = rows.select(s["state_id"].alias("ref"), score(mode, policy, q, s).alias("score"), s["artifact_class"].alias("artifact_class"), s["stream_id"].alias("stream_id"), s["segment_id"].alias("segment_id"), s["t_start"].alias("t_start"), s["t_end"].alias("t_end"), explanation(mode, policy, q, s).alias("explain"))
    return _ranked(rows, policy.top, F.desc("score"), F.asc("ref"))


def parse_band(spec: str) -> tuple[float, float]:
    try:
        a, b = map(float, spec.split(":"))
    except ValueError as e:
        raise QueryError("INVALID_BAND_SPEC", "band_spec must look like 'f0:f1' in Hz") from e
    return min(a, b), max(a, b)


def band_energy(bins: Column, low: float, high: float) -> Column:
    return F.aggregate(F.filter(bins, lambda b: (b["freq_hz"] >= low) & (b["freq_hz"] < high)), F.lit(0.0), lambda s, b: s + b["re"] * b["re"] + b["im"] * b["im"])


def band_lookup(states: DataFrame, band: str, scope: Scope, policy: Query, check: bool = True) -> DataFrame:
    """The states with the most energy in a band."""
    low, high = parse_band(band)
    rows = scoped(states, scope, check).withColumn("ref", F.col("state_id")).withColumn("score", band_energy(F.col("kept_bins"), low, high))
    rows = rows.withColumn("explain", F.struct(F.array(F.lit(low), F.lit(high)).alias("band_hz"), F.col("score").alias("band_energy")))
    return _ranked(rows.select(*_ITEM), policy.top, F.desc("score"), F.asc("ref"))


def energy_trend(states: DataFrame, scope: Scope, check: bool = True) -> DataFrame:
    """All states in scope by time, with their energy."""
    rows = scoped(states, scope, check).withColumns({"ref": F.col("state_id"), "score": F.col("energy_raw"), "explain": F.struct("energy_raw")})
    return _numbered(rows.select(*_ITEM), "t_start", "ref")


def compare(states: DataFrame, baseline: str, current: str, scope: Scope, mode: str, policy: Query, check: bool = True) -> DataFrame:
    """How alike two states of the scope are; if either isn't there, refused with ``check``, else no row."""
    if not baseline or not current:
        raise QueryError("INVALID_QUERY", "compare requires query.baseline_ref and query.current_ref")
    corpus = scoped(states, scope, check)
    if check and corpus.where(F.col("state_id").isin(baseline, current)).select("state_id").distinct().count() < len({baseline, current}):
        raise QueryError("REF_NOT_FOUND", "baseline_ref/current_ref not found in scoped corpus")
    side = lambda ref, name: corpus.where(F.col("state_id") == ref).limit(1).select(F.struct(*corpus.columns).alias(name))
    rows = side(baseline, "a").join(side(current, "b"))  # a row each
    a, b = F.col("a"), F.col("b")
    return rows.select(b["state_id"].alias("ref"), score(mode, policy, a, b).alias("score"), b["artifact_class"].alias("artifact_class"), b["stream_id"].alias("stream_id"), b["segment_id"].alias("segment_id"), b["t_start"].alias("t_start"), b["t_end"].alias("t_end"), explanation(mode, policy, a, b).alias("explain"), F.lit(1).alias("rank"))


#: Query class, answer postures with and without results, and what the answer doesn't claim (fixed values).
CLASSES = {"energy_trend": "Q0_observation", "similarity": "Q1_structural", "band_lookup": "Q1_structural", "compare": "Q1_structural"}
CEILINGS = {"Q0_observation": "L0_descriptive_only", "Q1_structural": "L0_descriptive_or_structural_support_only"}
ANSWERS = {"Q0_observation": ("descriptive_match_set", "descriptive_no_match"), "Q1_structural": ("structural_match_set", "structural_no_match")}
DOWNGRADES = {
    "Q0_observation": "observation-only | returned matches do not become structural continuity, memory, or identity claims",
    "Q1_structural": "structural-only | retrieval similarity does not become support, memory, continuity, or identity closure",
}
EMPTY = "empty result set | no stronger closure is justified from this query at the current seam"
NON_CLAIMS = ["not truth", "not canon", "not a memory claim", "not an identity claim"]


def envelope(results: DataFrame, kind: str, mode: str, scope: Scope, policy: Query) -> DataFrame:
    """One row on a result: class, ceiling, postures, policy id, filters, consulted states."""
    if kind not in CLASSES:
        raise QueryError("UNSUPPORTED_QUERY_KIND", f"Unsupported query kind: {kind}")
    cls = CLASSES[kind]
    claims = [*NON_CLAIMS, "not a structural continuity verdict" if cls == "Q0_observation" else "not a continuity verdict"]
    n = F.col("result_count")
    return results.agg(F.count(F.lit(1)).alias("result_count")).select(
        F.lit(kind).alias("kind"), F.lit(mode).alias("mode"), F.lit(cls).alias("query_class"), F.lit(CEILINGS[cls]).alias("claim_ceiling"),
        F.when(n > 0, F.lit(ANSWERS[cls][0])).otherwise(F.lit(ANSWERS[cls][1])).alias("answer_posture"),
        F.when(n > 0, F.lit(DOWNGRADES[cls])).otherwise(F.lit(EMPTY)).alias("downgrade_posture"),
        F.array(*map(F.lit, claims)).alias("explicit_non_claims"), F.lit(policy.id()).alias("query_policy_id"),
        F.array(*map(F.lit, scope.filters())).alias("filters") if scope.filters() else F.array().cast("array<string>").alias("filters"), "result_count",
    )
