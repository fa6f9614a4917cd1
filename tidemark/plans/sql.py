"""DuckDB SQL of the catalog's chain: samples, grid, frames, bins, states, as common table expressions."""

from __future__ import annotations

from ..sources.signals import EPOCH_US

#: Settings of the catalog's chain (hourly grid of event streams).
MULTIPLIER, SIZE, HOP, MISSING, BUDGET = 8, 64, 32, 0.25, 8
EDGES = (0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5)
THRESHOLD = 0.012
NEAR = 0.07

SAMPLES = f"""samples AS (SELECT event_type AS stream_id, event_id AS seq, (epoch_us(ts) - {EPOCH_US})::DOUBLE / 3.6e9 AS t, value AS v FROM events)"""

DIFFS = (
    SAMPLES
    + """,
diffs AS (SELECT *, t - t_prev AS dt FROM (SELECT *, lag(t) OVER w AS t_prev, lag(v) OVER w AS v_prev, row_number() OVER w AS rn FROM samples WINDOW w AS (PARTITION BY stream_id ORDER BY seq))),
steps AS (SELECT stream_id, median(dt) FILTER (dt > 0) AS nominal, list_sort(list(dt) FILTER (dt IS NOT NULL)) AS dts FROM diffs GROUP BY stream_id)"""
)

GRID = (
    DIFFS
    + """,
spans AS (SELECT stream_id, arg_min(t, seq) AS t0, arg_max(t, seq) AS t1 FROM samples GROUP BY stream_id),
points AS (SELECT stream_id, i, t0 + i * 1.0::DOUBLE AS tq FROM (SELECT stream_id, t0, unnest(range(CAST(floor(t1 - t0) AS BIGINT) + 1)) AS i FROM spans)),
later AS (SELECT * FROM diffs WHERE rn > 1),
bracket AS (SELECT p.stream_id, p.i, p.tq, d.t_prev, d.v_prev, d.t, d.v, d.dt FROM points p ASOF JOIN later d ON p.stream_id = d.stream_id AND p.tq <= d.t)"""
)


def aligned(value: str = "v_prev + (tq - t_prev) / dt * (v - v_prev)", held: str = "NULL") -> str:
    return (
        GRID
        + f""",
aligned AS (SELECT stream_id, i, tq, CASE WHEN dt > nominal * {MULTIPLIER} THEN {held} ELSE {value} END AS v FROM bracket JOIN steps USING (stream_id))"""
    )


def framed(fill: str = "interpolate", boundary: str = "truncate", taper: str = "hann") -> str:
    short = f"w * {HOP} + {SIZE} > len"
    pads = {
        "truncate": "SELECT * FROM held",
        "pad": f"SELECT * FROM held UNION ALL SELECT stream_id, w, len, t0, unnest(range(len - w * {HOP}, {SIZE})) AS n, NULL AS v FROM (SELECT DISTINCT stream_id, w, len, t0 FROM held WHERE {short})",
        "mirror_pad": f"SELECT * FROM held UNION ALL SELECT p.stream_id, p.w, p.len, p.t0, p.n, h.v FROM (SELECT stream_id, w, len, t0, len - w * {HOP} AS m, unnest(range(len - w * {HOP}, {SIZE})) AS n FROM (SELECT DISTINCT stream_id, w, len, t0 FROM held WHERE {short})) p JOIN held h ON h.stream_id = p.stream_id AND h.w = p.w AND h.n = CASE WHEN p.n % (2 * m) < m THEN p.n % (2 * m) ELSE 2 * m - 1 - p.n % (2 * m) END",
    }
    fills = {
        "interpolate": "coalesce(v, lv + (n - ln) / (rn - ln)::DOUBLE * (rv - lv))",
        "hold": "coalesce(v, lv)",
        "cut": "v",
    }
    weights = {"hann": "0.5 * (1 - cos(2 * pi() * n / (size - 1)))", "hamming": "0.54 - 0.46 * cos(2 * pi() * n / (size - 1))", "blackman": "0.42 - 0.5 * cos(2 * pi() * n / (size - 1)) + 0.08 * cos(4 * pi() * n / (size - 1))", "rectangular": "1.0"}
    last = f"WHERE w * {HOP} + {SIZE} < len OR w = (SELECT min(g.w) FROM good g WHERE g.stream_id = good.stream_id AND g.w * {HOP} + {SIZE} >= g.len)" if boundary == "truncate" else ""
    return (
        aligned()
        + f""",
lens AS (SELECT stream_id, max(i) + 1 AS len, arg_min(tq, i) AS first FROM aligned GROUP BY stream_id),
held AS (SELECT a.stream_id, w, len, first + w * {HOP} * 1.0::DOUBLE AS t0, i - w * {HOP} AS n, v FROM (SELECT *, unnest(range(CAST(greatest(0, ceil((i - {SIZE - 1}) / {HOP}.0)) AS BIGINT), CAST(floor(i / {HOP}.0) AS BIGINT) + 1)) AS w FROM aligned) a JOIN lens USING (stream_id)),
slots AS ({pads[boundary]}),
near AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER b AS ln, last_value(v IGNORE NULLS) OVER b AS lv, first_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER a AS rn, first_value(v IGNORE NULLS) OVER a AS rv, lag(v) OVER (PARTITION BY stream_id, w ORDER BY n) AS before
  FROM slots WINDOW b AS (PARTITION BY stream_id, w ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY stream_id, w ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
good AS (SELECT stream_id, w, len, any_value(t0) AS t0, count(*) AS size, count(*) FILTER (v IS NULL) AS missing, count(*) FILTER (v IS NULL AND (n = 0 OR before IS NOT NULL)) AS gaps FROM near GROUP BY stream_id, w, len HAVING count(*) FILTER (v IS NULL) / count(*)::DOUBLE <= {MISSING}),
frames AS (SELECT * FROM good {last}),
filled AS (SELECT near.stream_id, near.w, near.n, frames.t0, frames.size, {fills[fill]} AS v FROM near JOIN frames USING (stream_id, w)),
tapered AS (SELECT *, v * ({weights[taper]}) AS x FROM filled)"""
    )


BINS = (
    framed()
    + """,
whole AS (SELECT stream_id, w FROM tapered GROUP BY stream_id, w HAVING count(x) = count(*)),
terms AS (SELECT stream_id, w, t0, size, n, x, unnest(range(CAST(size / 2 AS BIGINT) + 1)) AS k FROM tapered JOIN whole USING (stream_id, w) WHERE size = 64),
bins AS (SELECT *, sqrt(re * re + im * im) AS magnitude, atan2(im, re) AS phase, k / size::DOUBLE AS freq_hz FROM (SELECT stream_id, w, t0, size, k, sum(x * cos(2 * pi() * k * n / size)) / size AS re, -sum(x * sin(2 * pi() * k * n / size)) / size AS im FROM terms GROUP BY stream_id, w, t0, size, k))"""
)

_CASES = " ".join(f"WHEN freq_hz >= {lo} AND freq_hz < {hi} THEN {i}" for i, (lo, hi) in enumerate(zip(EDGES, EDGES[1:], strict=False)))
BAND = f"CASE {_CASES} WHEN freq_hz = {EDGES[-1]} THEN {len(EDGES) - 2} ELSE -1 END"

KEPT = (
    BINS
    + f""",
ranked AS (SELECT *, {BAND} AS band, row_number() OVER (PARTITION BY stream_id, w ORDER BY CASE WHEN k = 0 THEN 0 ELSE 1 END, magnitude DESC, k) AS place FROM bins),
kept AS (SELECT * FROM ranked WHERE place <= {BUDGET})"""
)


def profile(table: str, out: str, keys: str = "stream_id, w") -> str:
    """Energy shares by band, one row a band, bands without bins included."""
    return f""",
{out}_raw AS (SELECT {keys}, b.band, coalesce(sum(re * re + im * im) FILTER (t.band = b.band), 0) AS e FROM {table} t CROSS JOIN (SELECT unnest(range({len(EDGES) - 1})) AS band) b GROUP BY {keys}, b.band),
{out} AS (SELECT {keys}, band, CASE WHEN sum(e) OVER p = 0 THEN 0 ELSE e / sum(e) OVER p END AS share FROM {out}_raw WINDOW p AS (PARTITION BY {keys}))"""


STATES = (
    KEPT
    + profile("kept", "shares")
    + f""",
vectors AS (SELECT stream_id, w, list(share ORDER BY band) AS profile FROM shares GROUP BY stream_id, w),
energies AS (SELECT stream_id, w, any_value(t0) AS t_start, any_value(t0) + any_value(size) AS t_end, sum(re * re + im * im) AS energy_raw, sum(re * re + im * im) FILTER (place <= {BUDGET}) AS energy_kept,
  sqrt(coalesce(sum(CASE WHEN 2 * k = size OR k = 0 THEN re * re ELSE 2 * (re * re + im * im) END) FILTER (place > {BUDGET}), 0)) / any_value(size) AS recon_rmse FROM ranked GROUP BY stream_id, w),
states AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY w) AS ord FROM energies JOIN vectors USING (stream_id, w))"""
)


def l1(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: abs(p[1] - p[2])))"


FOLD = STATES.replace("samples AS", "samples AS", 1) + f""",
fold AS (
  SELECT stream_id, ord, w, t_start, t_end, energy_raw, profile, 0::BIGINT AS epoch, profile AS base, w AS base_w, NULL::DOUBLE AS divergence, false AS novelty, NULL::BIGINT AS against FROM states WHERE ord = 1
  UNION ALL
  SELECT s.stream_id, s.ord, s.w, s.t_start, s.t_end, s.energy_raw, s.profile,
    CASE WHEN f.novelty THEN f.epoch + 1 ELSE f.epoch END,
    CASE WHEN f.novelty THEN s.profile ELSE f.base END,
    CASE WHEN f.novelty THEN s.w ELSE f.base_w END,
    CASE WHEN f.novelty THEN NULL ELSE {l1("s.profile", "f.base")} END,
    CASE WHEN f.novelty THEN false ELSE {l1("s.profile", "f.base")} > {THRESHOLD} END,
    CASE WHEN f.novelty THEN NULL ELSE f.base_w END
  FROM fold f JOIN states s ON s.stream_id = f.stream_id AND s.ord = f.ord + 1),
segmented AS (SELECT *, 'seg:' || stream_id || ':' || epoch AS segment_id FROM fold)"""
