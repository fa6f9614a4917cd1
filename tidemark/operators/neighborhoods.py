"""Threshold clusters of states by the distance of their band profiles.

Single linkage at a threshold is the same as the connected components of the
pairs closer than it; complete linkage depends on the order of merges and runs
component by component.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import ship
from ..functions.numbers import fnv32a
from ..functions.vectors import l1
from ..plans.policies import Neighborhood
from .components import components, written

KEY = "segment_id"


def cells(profile: Column, width: float) -> tuple[Column, Column]:
    """The cell of a profile in a grid of this width: by its first coordinate, and by its coordinates summed with alternating signs.

    Neither differs by more than the profiles' distance, so profiles that are
    closer than the width lie in the same or in adjoining cells.
    """
    turned = F.aggregate(F.transform(profile, lambda x, i: F.when(i % 2 == 0, x).otherwise(-x)), F.lit(0.0), lambda s, x: s + x)
    first = F.coalesce(F.try_element_at(profile, F.lit(1)), F.lit(0.0))
    return tuple(F.floor(F.coalesce(x, F.lit(0.0)) / F.lit(float(width))).cast("long") for x in (first, turned))


def around(cell: Column) -> Column:
    return F.explode(F.array(cell - 1, cell, cell + 1))


def close_pairs(states: DataFrame, threshold: float, by: str = KEY, strict: bool = True) -> DataFrame:
    """``by, a, b, distance`` of states (``node``, ``profile``) of one group that are closer than the threshold.

    States are dealt to ``cells`` of the threshold's width, and only equal and
    adjoining cells meet.  A null profile is close to none.
    """
    x, y = cells(F.col("profile"), threshold)
    some = states.where("profile is not null")
    left = some.select(by, F.col("node").alias("a"), F.col("profile").alias("pa"), around(x).alias("x"), y.alias("__y")).select(by, "a", "pa", "x", around(F.col("__y")).alias("y"))
    right = some.select(by, F.col("node").alias("b"), F.col("profile").alias("pb"), x.alias("x"), y.alias("y"))
    pairs = left.join(right, [by, "x", "y"]).where("a < b").withColumn("distance", l1(F.col("pa"), F.col("pb")))
    near = F.col("distance") < threshold if strict else F.col("distance") <= threshold
    return pairs.where(near).select(by, "a", "b", "distance")


def single_link(states: DataFrame, threshold: float, by: str = KEY) -> DataFrame:
    """``by, node, label``: clusters named by their smallest node; a null profile is a cluster of its own."""
    return components(states.select(by, "node"), close_pairs(states, threshold, by), by)


def merged_pairs(a: list[int], b: list[int], distance: list[float]) -> dict[int, int]:
    """Complete linkage over the pairs closer than the threshold: node -> label, the smallest node of its cluster.

    The closest pair of clusters merges first, of equal ones that with the
    lower names.  Two clusters are as far apart as their farthest members, and
    can't merge once any two of their members are no pair, so a cluster keeps
    the neighbours that both of its parts have.
    """
    near: dict[int, dict[int, float]] = defaultdict(dict)
    for i, j, d in zip(a, b, distance, strict=True):
        near[i][j] = near[j][i] = d
    label = {i: [i] for i in near}
    heap = [(d, min(i, j), max(i, j)) for i, j, d in zip(a, b, distance, strict=True)]
    heapq.heapify(heap)
    while heap:
        d, i, j = heapq.heappop(heap)
        if i not in label or j not in label or near[i].get(j) != d:
            continue
        mine, theirs = near.pop(i), near.pop(j)
        near[i] = {}
        label[i] += label.pop(j)
        for k in mine.keys() | theirs.keys():
            if k in (i, j):
                continue
            near[k].pop(i, None)
            near[k].pop(j, None)
            if k in mine and k in theirs:
                far = max(mine[k], theirs[k])
                near[i][k] = near[k][i] = far
                heapq.heappush(heap, (far, min(i, k), max(i, k)))
    return {node: i for i, nodes in label.items() for node in nodes}


def complete_link(states: DataFrame, threshold: float, by: str = KEY) -> DataFrame:
    """As ``single_link``, a cluster's farthest members being closer than the threshold.

    Only what single linkage joins can merge, so the pairs are dealt by its
    clusters; those of one must fit its task.
    """
    ship(states.sparkSession)
    pairs = written(close_pairs(states, threshold, by))
    joined = written(components(states.select(by, "node"), pairs, by))
    dealt = pairs.join(joined.select(by, F.col("node").alias("a"), F.col("label").alias("part")), [by, "a"])

    def run(table: pa.Table) -> pa.Table:
        found = merged_pairs(*(table.column(c).to_pylist() for c in ("a", "b", "distance")))
        return pa.table([pa.array([table.column(by)[0].as_py()] * len(found), pa.string()), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["of", "member", "label"])

    merged = dealt.select(by, "part", "a", "b", "distance").groupBy(by, "part").applyInArrow(run, "of string, member long, label long")
    return joined.select(by, "node").join(merged, (F.col(by) == F.col("of")) & (F.col("node") == F.col("member")), "left").select(by, "node", F.coalesce("label", "node").alias("label"))


def summaries(states: DataFrame, labels: DataFrame, policy: Neighborhood = Neighborhood(), by: str = KEY) -> DataFrame:
    """One row a cluster of enough members: weighted centroid, radius, mean distance, span, members."""
    rows = states.join(labels, [by, "node"])
    weight = F.greatest(F.lit(0.0), F.col("t_end") - F.col("t_start")) if policy.weight_mode == "duration" else F.lit(1.0)
    rows = rows.withColumn("weight", weight)
    spread = rows.select(by, "label", "weight", F.posexplode("profile").alias("band", "share"))
    centroid = spread.groupBy(by, "label", "band").agg(F.when(F.sum("weight") == 0, F.lit(0.0)).otherwise(F.sum(F.col("weight") * F.col("share")) / F.sum("weight")).alias("share"))
    centroid = centroid.groupBy(by, "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "share"))), lambda x: x["share"]).alias("centroid"))
    far = rows.join(centroid, [by, "label"]).withColumn("distance", l1(F.col("profile"), F.col("centroid")))
    out = far.groupBy(by, "label").agg(
        F.count(F.lit(1)).alias("member_count"),
        F.first("centroid").alias("centroid"),
        F.when(F.sum("weight") == 0, F.lit(0.0)).otherwise(F.sum(F.col("weight") * F.col("energy_raw")) / F.sum("weight")).alias("centroid_energy_raw"),
        F.max("distance").alias("radius"),
        F.avg("distance").alias("mean_distance"),
        F.sum(F.col("t_end") - F.col("t_start")).alias("total_duration_sec"),
        F.min("t_start").alias("t_start"),
        F.max("t_end").alias("t_end"),
        F.array_sort(F.collect_list("state_id")).alias("member_state_ids"),
    )
    return out.where(F.col("member_count") >= policy.min_member_count)


def cluster_id(stream: str, segment: str, centroid: list[float], index: int) -> str:
    """The id under which a cluster is stored; it hashes the rounded centroid."""
    text = ",".join(str(math.floor(x * 1e4 + 0.5)) for x in centroid)
    return f"BN:{stream}:{segment}:c{index}:{fnv32a(text)}"


def nearest(states: DataFrame, clusters: DataFrame, threshold: float | None = None, by: str = KEY) -> DataFrame:
    """Each state with the closest centroid of its group (ties: the first by label); beyond the threshold none."""
    some = clusters.select(by, F.col("label").alias("nearest"), "centroid")
    rows = states.join(some, by, "left").withColumn("distance", F.when(F.col("nearest").isNotNull(), l1(F.col("profile"), F.col("centroid"))))
    order = Window.partitionBy(by, "node").orderBy(F.col("distance").asc_nulls_last(), "nearest")
    best = rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "centroid")
    if threshold is None:
        return best
    near = F.col("distance") <= threshold
    return best.withColumns({"nearest": F.when(near, F.col("nearest")), "distance": F.when(near, F.col("distance"))})


def rebuilt(states: DataFrame, stored: DataFrame | None, frames: DataFrame, policy: Neighborhood = Neighborhood(), segments: list[str] | None = None, by: str = KEY) -> tuple[DataFrame, DataFrame]:
    """(the clusters after those of some segments are made anew, the frames with these segments assigned again).

    ``stored`` has the columns of ``summaries``; other segments' clusters and
    frames stay as they are.  ``frames`` has ``node, profile, nearest, distance``.
    Segments without a state are refused.
    """
    if segments is not None:
        states = states.where(F.col(by).isin(segments))
        have = {r[by] for r in states.select(by).distinct().collect()}  # as many as are named
        if lost := [x for x in segments if x not in have]:
            raise ValueError(f"NO_STATES: no committed states found for {', '.join(lost)}")
    link = single_link if policy.linkage == "single_link" else complete_link
    new = written(summaries(states, link(states, policy.similarity_threshold, by), policy, by))
    touched = states.select(by).distinct()
    clusters = new if stored is None else stored.join(touched, by, "left_anti").unionByName(new)
    again = frames.join(touched, by, "left_semi").drop("nearest", "distance")
    placed = nearest(again, new.select(by, "label", "centroid"), policy.similarity_threshold, by)
    return clusters, frames.join(touched, by, "left_anti").unionByName(placed.select(*frames.columns))
