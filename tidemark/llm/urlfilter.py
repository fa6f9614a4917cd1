"""URL rules by a sort-merge range join, in DataFrame functions only.

A host's labels are reversed (``a.example.net`` -> ``net.example.a.``), so a
rule for a host and all its subdomains is one interval of keys, and a path
prefix is one interval below its host.  Such intervals are nested or disjoint.
A *sweep* sorts interval boundaries and points together into range partitions;
each boundary carries the stack of intervals that are open after it, so a
point's stack is that of the last boundary before it, and a partition's first
points take theirs over from the partitions before.

Two sweeps find a rule: one over distinct hosts (which ruled hosts enclose
it), one over distinct (ruled host, path) keys (the innermost path prefix).
Hot hosts and urls are aggregated to one row before either; the decisions are
joined back by (host, path).

Inputs: a null url, or one without ``://``, has empty host and path and gets
the default verdict.  Rules with a null or empty host are refused.  Of rules
with equal host and path, ``block`` wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, partitions, pick

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    after = F.substring(url, F.instr(url, "://") + 3, 1 << 30)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    after = F.substring(url, F.instr(url, "://") + 3, 1 << 30)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each ended by a dot: a subdomain's key starts with its parent's."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def sweep(points: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Adds ``stack`` to points: what the last boundary at or before their ``key`` (binary) carries, null before the first.

    ``boundaries`` has ``key`` and ``stack`` (never null).  The carry-over
    table has a row for each partition, which bounds its broadcast.
    """
    spark = points.sparkSession
    kind = boundaries.schema["stack"].dataType
    rest = [c for c in points.columns if c != "key"]
    both = boundaries.select("key", F.lit(0).alias("__kind"), "stack", *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in rest]).unionByName(
        points.select("key", F.lit(1).alias("__kind"), F.lit(None).cast(kind).alias("stack"), *rest)
    )
    order = ["key", "__kind"]
    dealt = cut(both.repartitionByRange(partitions(spark), *order).withColumn("__part", F.spark_partition_id()))
    ends = dealt.where("__kind = 0").groupBy("__part").agg(F.max_by("stack", "key").alias("__last"))
    parts = dealt.select("__part").distinct().join(ends, "__part", "left")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select("__part", F.last("__last", True).over(before).alias("__carry"))
    here = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        dealt.withColumn("stack", F.last("stack", True).over(here))
        .where("__kind = 1")
        .join(F.broadcast(carry), "__part")
        .select("key", *rest, F.coalesce("stack", "__carry").alias("stack"))
    )


def _end(key: Column) -> Column:
    """The least key above all that start with ``key``: byte FF occurs in no UTF-8 text."""
    return F.concat(key, F.unhex(F.lit("FF")))


def _host_boundaries(rules: DataFrame) -> DataFrame:
    """Boundaries of ruled hosts; the stack lists the open ones' keys, outermost first (a host has 127 labels at most)."""
    nodes = rules.select("node").distinct()
    parts = F.split(F.col("node"), r"\.", -1)
    above = nodes.select("node", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "."), F.lit(".")))).alias("up"))
    chains = above.join(nodes.select(F.col("node").alias("up")), "up").groupBy("node").agg(F.array_sort(F.collect_set("up")).alias("chain"))
    start = chains.select(F.col("node").cast("binary").alias("key"), F.col("chain").alias("stack"))
    end = chains.select(_end(F.col("node").cast("binary")).alias("key"), F.slice("chain", F.lit(1), F.size("chain") - 1).alias("stack"))
    return start.unionByName(end)


def _path_key(node: Column, path: Column) -> Column:
    return F.concat(node.cast("binary"), F.unhex(F.lit("00")), path.cast("binary"))


def _path_boundaries(rules: DataFrame) -> DataFrame:
    """Boundaries of rules below their host; the stack is its top: the innermost open rule, or a struct of nulls."""
    top = F.struct("rule", "verdict")
    longer = rules.select("node", "path", F.explode(F.when(F.length("path") > 0, F.sequence(F.lit(0), F.length("path") - 1)).otherwise(F.array())).alias("n")).select("node", "path", F.expr("substring(path, 1, n)").alias("up"))
    outer = rules.select("node", F.col("path").alias("up"), top.alias("outer"))
    parents = longer.join(outer, ["node", "up"]).groupBy("node", "path").agg(F.max_by("outer", F.length("up")).alias("outer"))
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    full = rules.join(parents, ["node", "path"], "left").select(_path_key(F.col("node"), F.col("path")).alias("key"), top.alias("own"), F.coalesce("outer", none).alias("outer"))
    return full.select("key", F.col("own").alias("stack")).unionByName(full.select(_end(F.col("key")).alias("key"), F.col("outer").alias("stack")))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every page: the longest rule that fits, or the default."""
    given = pick(rules, "host", "path", "verdict").select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host is not null and host <> ''")
    known = given.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(host_key(F.col("host")).alias("node"), "path", F.concat("host", "path").alias("rule"), "verdict")
    urls = pick(pages, page_id=id_col, url=url_col).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    places = urls.where("host <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).select("host", "path")
    hosts = places.select("host").distinct().select("host", host_key(F.col("host")).cast("binary").alias("key"))
    enclosed = sweep(hosts, _host_boundaries(known)).where(F.size("stack") > 0).select("host", "stack")
    inner = places.join(enclosed, "host").select("host", "path", F.explode("stack").alias("node"))
    swept = sweep(inner.select("host", "path", _path_key(F.col("node"), F.col("path")).alias("key")), _path_boundaries(known))
    best = swept.where("stack.rule is not null").groupBy("host", "path").agg(F.max_by("stack", F.struct(F.length("stack.rule"), "stack.rule")).alias("best"))
    # pages without a url have no rule: they are dealt by their ids, not all by one empty host
    spread = F.when(F.col("host") == "", F.pmod(F.xxhash64("page_id"), F.lit(1 << 20))).otherwise(F.lit(0)).alias("__spread")
    some = urls.select("page_id", "host", "path", spread).join(best.withColumn("__spread", F.lit(0).cast("long")), ["host", "path", "__spread"], "left")
    return some.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
