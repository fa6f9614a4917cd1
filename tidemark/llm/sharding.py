"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A document descends from the root through region and rack to a shard.  At each
level every child draws ``-ln(u) / weight`` with ``u`` a hash of document and
child, and the smallest draw wins, so a child's share follows its weight.  A
draw depends on nothing but the document, the child and the child's weight:
changing weights moves documents only into or out of the subtrees whose
weights changed.  A grown tree adds each new shard as a region of its own, so
that documents move into the new shard and nowhere else.

Inputs: null ids hash as the text ``null``; null texts count as empty; repeated
rows get neighbouring slots; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]

BASE_SHARDS = 16


def tree(shards: int, racks: int = 2, per_rack: int = 2, base: int = BASE_SHARDS) -> Tree:
    """Equal weights: up to ``base`` shards fill regions of ``racks`` x ``per_rack``; each shard beyond is a region of its own."""
    out: Tree = {}
    for shard in range(shards):
        if shard < base:
            region, rest = divmod(shard, racks * per_rack)
            out.setdefault(f"g{region}", {}).setdefault(f"k{rest // per_rack}", {})[shard] = 1.0
        else:
            out[f"x{shard}"] = {"k0": {shard: 1.0}}
    return out


def _draw(doc: Column, path: Column, child: str, weight: float) -> Column:
    """52 bits of MD5 as a uniform number in (0, 1), as an exponential draw at the child's rate."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("/", doc, path, F.lit(child)).cast("binary")), 1, 13), 16, 10).cast("long")
    return -F.ln((bits.cast("double") + 0.5) / F.lit(float(1 << 52))) / F.lit(float(weight))


def _winner(doc: Column, path: Column, children: dict[str, float]) -> Column:
    """(draw, name) of the child with the smallest draw; ties go to the smaller name."""
    draws = [F.struct((_draw(doc, path, name, weight) if len(children) > 1 else F.lit(0.0)).alias("draw"), F.lit(name).alias("name")) for name, weight in sorted(children.items())]
    return F.array_min(F.array(*draws))


def _level(doc: Column, path: Column, below: dict[str, dict[str, float]]) -> Column:
    """The winning child's name under whichever node ``path`` names; nodes with equal children share an expression."""
    kinds: dict[tuple, list[str]] = {}
    for node, children in below.items():
        kinds.setdefault(tuple(sorted(children.items())), []).append(node)
    out = None
    for children, nodes in kinds.items():
        name = _winner(doc, path, dict(children))["name"]
        out = name if len(kinds) == 1 else (F.when if out is None else out.when)(path.isin(nodes), name)
    return out


def descend(df: DataFrame, doc: str, shape: Tree, out: str) -> DataFrame:
    """Adds column ``out``, the shard (int) that the tree gives to the text column ``doc``, and ``__{out}_draw``, its region's draw."""
    key, top, rack, leaf = F.col(doc), f"__{out}_top", f"__{out}_rack", f"__{out}_leaf"
    racks = {g: {k: sum(ss.values()) for k, ss in ks.items()} for g, ks in shape.items()}
    leaves = {f"{g}/{k}": {str(i): w for i, (_, w) in enumerate(sorted(ss.items()))} for g, ks in shape.items() for k, ss in ks.items()}
    shards = [(f"{g}/{k}/{i}", s) for g, ks in shape.items() for k, ss in ks.items() for i, s in enumerate(sorted(ss))]
    df = df.withColumn(top, _winner(key, F.lit("root"), {g: sum(ks.values()) for g, ks in racks.items()}))
    df = df.withColumn(rack, F.concat_ws("/", F.col(top)["name"], _level(key, F.col(top)["name"], racks)))
    df = df.withColumn(leaf, F.concat_ws("/", F.col(rack), _level(key, F.col(rack), leaves)))
    named = F.create_map(*[F.lit(x) for pair in shards for x in pair])
    return df.withColumn(out, F.element_at(named, F.col(leaf)).cast("int")).withColumn(f"__{out}_draw", F.col(top)["draw"]).drop(top, rack, leaf)


def grow(df: DataFrame, doc: str, shard: str, new: int, out: str) -> DataFrame:
    """Adds column ``out``: the shard once shard ``new`` is there, a region of its own.

    All other draws stay as they are, so the new region wins a document or
    nothing changes for it.
    """
    won = _draw(F.col(doc), F.lit("root"), f"x{new}", 1.0) < F.col(f"__{shard}_draw")
    return df.withColumn(out, F.when(won, F.lit(new)).otherwise(F.col(shard)).cast("int"))


def assign(docs: DataFrame, shards: int = BASE_SHARDS, buckets: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, slot and the shard under one shard more for every row.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.  Slots
    number a shard's rows from 0 without gaps: rows are dealt to ``buckets``
    hash buckets a shard, bucket counts (shards x buckets rows at most, so they
    may be broadcast) give each bucket its first slot, and rows are numbered
    inside their bucket, so no task ever holds a whole shard.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__key"),
    )
    rows = grow(descend(rows, "__key", tree(shards), "shard"), "__key", "shard", shards, "grown_shard")
    rows = rows.withColumn("__bucket", F.pmod(F.conv(F.substring(F.md5(F.col("__key").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("shard", "__bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("__at", F.row_number().over(inside) - 1)
        .join(F.broadcast(first), ["shard", "__bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__first") + F.col("__at")).cast("long").alias("slot"), "grown_shard")
    )
