"""Mixing sources to target weights by weighted fair queueing.

A source's documents are shuffled by hash and served one after the other, then
once more.  A served document's *virtual finish time* is the words its source
has served by its end, divided by the source's target; a source reaches its
target at virtual time 1, and a document that is being served then is two
packets, up to that word and from it on.  All packets are sorted by finish
time over all sources (in ranges of virtual time, so no task sorts them all),
and the running total of words over the sorted ranges decides what is taken:
the mix ends where the budget, all targets' whole words, is used up.

Targets share ``budget`` x all words by weight; none exceeds ``repeats`` times
its source's words, and the excess goes to the others by weight.

Inputs: a null text has size 0 and is never served; a null source is a source
of its own, last in order; null ids are shuffled by their texts; rows with
equal ids and texts count each for itself; which of them is served first makes
no difference, so reruns agree; an empty table gives an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, pick, place, prepare, size_of

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
REPEATS = 2
#: Rows of a shuffle bucket and of a range of virtual time, about: their numbers grow with the table.
BUCKET_ROWS, RANGE_ROWS, RANGES = 4096, 20_000, 1024

#: What tells a scheduled row apart.
ROW = ("__s", "__bucket", "__n")
FIRST = (Window.unboundedPreceding, -1)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """``source, source_size, target`` from rows ``source, size``.

    Works on one row a source.  Sources in order of the virtual level at which
    they reach their cap: the level where all of the budget is used lies in
    the first stretch whose end is not below it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    cycle = F.pmod(F.row_number().over(named) - 1, F.lit(n))
    weight = F.element_at(F.array(*map(F.lit, weights)), (cycle + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * repeats)
    level = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    by_level = Window.orderBy(*level)
    capped_before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(*FIRST)), F.lit(0))
    weight_from = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    per = per.withColumn("here", (total * F.lit(float(budget)) - capped_before) / weight_from).withColumn("nth", F.row_number().over(by_level))
    water = F.min(F.when(F.col("here") <= F.col("cap") / F.col("weight"), F.struct("nth", "here"))).over(Window.partitionBy())["here"]
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(water, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def _order() -> list[Column]:
    """Shuffle order inside a source."""
    return [F.col("__shuffle"), F.col("doc_id"), F.col("size"), F.col("__print")]


def _sized(rows: DataFrame) -> DataFrame:
    """Narrow rows of ``doc_id, text, source, __print``: the texts' sizes and the shuffle's hash (a null id's is its text's)."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.coalesce(F.xxhash64("text").cast("string"), F.lit(""))))
    named = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("none"))
    return cut(rows.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.md5(key.cast("binary")).alias("__shuffle"), "__print", named.alias("__s")))


def schedule(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """Each row of ``_sized`` with ``source_size, target, begin``: the words its source serves before it in a round."""
    digits = max(2, math.ceil(math.log(max(1, sized.count() / BUCKET_ROWS), 16)))
    rows = sized.withColumn("__bucket", F.substring("__shuffle", 1, digits))
    sums = rows.groupBy("__s", "source", "__bucket").agg(F.sum("size").alias("__words"))
    per = targets(sums.select("source", F.col("__words").alias("size")), weights, budget, repeats)
    before = Window.partitionBy("__s").orderBy("__bucket").rowsBetween(*FIRST)
    lead = sums.select("__s", "source", "__bucket", F.coalesce(F.sum("__words").over(before), F.lit(0)).alias("__first"))
    lead = lead.join(per.withColumnRenamed("source", "__p"), F.col("source").eqNullSafe(F.col("__p"))).drop("__p", "source")
    inside = Window.partitionBy("__s", "__bucket").orderBy(*_order())
    rows = rows.withColumns({"__inside": F.coalesce(F.sum("size").over(inside.rowsBetween(*FIRST)), F.lit(0)), "__n": F.row_number().over(inside)})
    return cut(rows.join(lead, ["__s", "__bucket"]).withColumn("begin", (F.col("__first") + F.col("__inside")).cast("long")).drop("__first", "__inside"))


def _packets(repeats: int) -> Column:
    """A row's packets: one a round, or two where the source's target ends inside it."""
    quota, size = F.floor("target"), F.col("size")

    def of(k: Column) -> Column:
        at = F.col("begin") + k * F.col("source_size")
        packet = lambda start, words: F.struct(k.cast("int").alias("round"), start.cast("long").alias("at"), words.cast("long").alias("words"))
        return F.when((at < quota) & (at + size > quota), F.array(packet(at, quota - at), packet(quota, at + size - quota))).otherwise(F.array(packet(at, size)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), of))


def serve(planned: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """The packets of the mix, of a cut schedule: ``round, words`` taken, ``finish``, ``mix_offset`` (words of the mix before it)."""
    total = planned.groupBy("__s").agg(F.first("target").alias("target")).agg(F.sum(F.floor("target"))).first()[0] or 0
    ranges = max(RANGES, planned.count() // RANGE_ROWS)
    sent = planned.where("size > 0 and target > 0").withColumn("__p", F.explode(_packets(repeats))).select(*planned.columns, "__p.*")
    sent = sent.withColumn("finish", (F.col("at") + F.col("words")) / F.col("target"))
    # up to 1 virtual time is cut evenly; what finishes later is in ranges that grow longer
    late = ranges + F.floor((1 - 1 / F.col("finish")) * ranges)
    sent = sent.withColumn("__range", F.when(F.col("finish") <= 1, F.floor(F.col("finish") * ranges)).otherwise(late + 1).cast("long"))
    sums = sent.groupBy("__range").agg(F.sum("words").alias("__words"))
    first = sums.select("__range", F.coalesce(F.sum("__words").over(Window.orderBy("__range").rowsBetween(*FIRST)), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("__range").orderBy("finish", F.col("source").asc_nulls_last(), "round", *_order(), "at").rowsBetween(*FIRST)
    # ranges that begin beyond the budget hold nothing of the mix
    sent = sent.join(first.where(F.col("__first") < total), "__range").withColumn("__inside", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    sent = sent.withColumn("mix_offset", (F.col("__first") + F.col("__inside")).cast("long"))
    return sent.withColumn("words", F.least(F.col("words"), total - F.col("mix_offset")).cast("long")).where("words > 0").drop("__range", "__first", "__inside", "at")


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, how: dict) -> DataFrame:
    rows = pick(docs, doc_id=id_col, text=text_col, source=source_col)
    return schedule(_sized(rows.withColumn("__print", F.xxhash64("text"))), **how)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The packets of the mix with ``doc_id, source, size, round, words, finish, mix_offset``."""
    return serve(_planned(docs, id_col, text_col, source_col, how), how.get("repeats", REPEATS)).select("doc_id", "source", "size", "round", "words", "finish", "mix_offset")


def shares(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``doc_id, size, source_size, target, taken, mix_offset`` for every row of documents; ``mix_offset`` is its first, null if it isn't in the mix."""
    planned = _planned(docs, id_col, text_col, source_col, how)
    taken = serve(planned, how.get("repeats", REPEATS)).groupBy(*ROW).agg(F.sum("words").alias("taken"), F.min("mix_offset").alias("mix_offset"))
    return planned.join(taken, [*ROW], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "mix_offset")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix as rows of documents, each as often as it is served; one that the mix takes in part has the words taken.

    Serving is decided on narrow rows, and the texts are shuffled once.  Rows
    equal in all columns are one row by then that is served for all of them.
    """
    prepare(docs.sparkSession)
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text, source = (F.col(f"c{place(names, c)}") for c in (id_col, text_col, source_col))
    rows = rows.withColumn("__row", F.xxhash64(*[x for c in rows.columns for x in (F.col(c).isNull(), F.col(c))]))
    planned = schedule(_sized(rows.select(doc_id.alias("doc_id"), text.alias("text"), source.alias("source"), F.col("__row").alias("__print"))), **how)
    both = ["__hash", "__row"]
    # the shuffle's hash stands for the id beside the row's own
    served = serve(planned, how.get("repeats", REPEATS)).groupBy(*ROW, "round").agg(F.sum("words").alias("__w"), F.first("size").alias("__z"), F.first("__shuffle").alias("__hash"), F.first("__print").alias("__row")).select(*both, "__w", "__z")
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null"), F.coalesce(F.xxhash64(text).cast("string"), F.lit(""))))
    rows = rows.withColumn("__hash", F.md5(key.cast("binary")))
    again = cut(planned.select(F.col("__shuffle").alias("__hash"), F.col("__print").alias("__row")).groupBy(*both).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*both))
    if not again.isEmpty():
        rows = rows.join(again, both, "left_anti").unionByName(rows.join(again, both, "left_semi").dropDuplicates(both))
    part = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.col("__w").cast("int")), " ")
    cast = docs.schema[place(names, text_col)].dataType
    whole = rows.join(served, both).select(*[F.when(F.col("__w") < F.col("__z"), part).otherwise(text).cast(cast).alias(f"c{i}") if i == place(names, text_col) else F.col(f"c{i}") for i in range(len(names))])
    return whole.toDF(*names)
