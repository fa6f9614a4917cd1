"""SimHash near-duplicates with bit-sliced comparison.

``fingerprints`` hashes word shingles; bit ``i`` of a fingerprint is set where
over half the shingles' hashes have it.  Documents with one fingerprint form a
class, stood for by the smallest id, so a group of copies is one row from then
on.  Classes meet in tables of buckets:

* ``exact_tables``: the bits are cut into blocks; fingerprints that differ in
  ``radius`` bits agree on all but ``radius`` blocks at least, so a table for
  each choice of the agreeing blocks misses no pair.
* ``sampled_tables`` for radii too wide for that: each table keys on a random
  choice of bits; their number follows from the recall asked for.

Inside a bucket bit planes of the differences are stored vertically (one bit a
pair), and distances are added up by carry-save bitwise counters; a block of
pairs is left as soon as all of it is beyond the radius.  A small bucket
compares its pairs at once; in a larger one each newly reached class is
compared with the classes not reached yet, so what a bucket emits is a forest
with fewer links than classes.  For small radii a bucket of over ``SPLIT``
classes, as a common block of bits makes, is first cut by finer tables over the
bits that differ in it, which miss no pair of it either.  Links are joined into
components by stars, each round cut to a table.

``similar`` and ``representatives`` take fingerprints as candidates only: what
they join has an exact Jaccard similarity of shingle sets (up to collisions of
64-bit hashes), found among the sets that candidates join, without a row for
each pair.

Inputs: null and empty texts have no words and the fingerprint zero; texts
shorter than a shingle are one shingle; repeated rows share a class; rows that
repeat a ``doc_id`` are one document in ``groups`` and ``similar``, and each a
row of its own in ``representatives``; a null ``doc_id`` forms no links in
``groups``, and its text is one of its group's in ``representatives``; an empty
table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, lean, partitions, pick, runs
from .textkernel import chunks, mix64

SEED = 42
BLOCK = 4096
SMALL = 8
#: Classes beyond which a bucket is cut by further bits.
SPLIT = 2048
#: Least hashes in a key of ``similar``.
ROWS = 6
#: Sets in a lot that is verified at once, and shingles beyond which what candidates join is verified in parts.
LOT = 500
LARGE = 2_000_000

Table = tuple[int, ...]  # a mask for each 64-bit lane


def _shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles, and how many each text has."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    out, counts = [], np.zeros(len(texts), dtype=np.int64)
    for row, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        if len(words) <= size:
            found = [digest(joined, SEED)]
        else:
            starts = [0, *(ends[: len(words) - size] + 1).tolist()]
            found = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]
        counts[row] = len(found)
        out += found
    return np.array(out, dtype=np.uint64), counts


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text the bits set in over half its hashes; zero for a text without any."""
    out = np.zeros(len(counts), dtype=np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
        votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * votes > counts[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, f0 .. f{lanes-1}``: fingerprints of 64 bits a lane, as signed longs.  Lane 0 is the hash itself, further lanes mix it anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in chunks(batch, "text", 1 << 20):
                hashes, counts = _shingles([t or b"" for t in some.column(1).to_pylist()], shingle)
                prints = [majority(hashes if k == 0 else mix64(hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), counts) for k in range(lanes)]
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(p.view(np.int64)) for p in prints)], names=["doc_id", *(f"f{k}" for k in range(lanes))])

    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("binary")).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(lean(run), "doc_id long, " + ", ".join(f"f{k} long" for k in range(lanes)))


def exact_tables(radius: int, classes: int, bits: int = 64) -> list[Table]:
    """Tables that miss no pair within the radius, with keys of about log2(classes) bits or more."""
    need = max(1.0, math.log2(max(2, classes)) - 1)
    blocks = next((b for b in range(radius + 1, bits) if (b - radius) * bits / b >= need), bits)
    cuts = [i * bits // blocks for i in range(blocks + 1)]
    masks = [sum(1 << i for i in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [_lanes(sum(chosen), bits) for chosen in itertools.combinations(masks, blocks - radius)]


def sampled_tables(agree: float, classes: int, bits: int, recall: float) -> list[Table]:
    """Tables over random bits: a pair that agrees on a share ``agree`` of all bits meets in one with probability ``recall``."""
    width = max(16, math.ceil(math.log2(max(2, classes))))
    number = math.ceil(math.log(1 - recall) / math.log(1 - agree**width))
    draw = random.Random(SEED)
    return [_lanes(sum(1 << i for i in draw.sample(range(bits), width)), bits) for _ in range(number)]


def _lanes(mask: int, bits: int) -> Table:
    words = [(mask >> 64 * k) & (1 << 64) - 1 for k in range(bits // 64)]
    return tuple(w - (1 << 64) if w >> 63 else w for w in words)


def _planes(words: np.ndarray) -> np.ndarray:
    """Bit planes of (pairs x lanes) words: (bits x pairs/8) bytes."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1), axis=1)
    return np.packbits(bits.T, axis=1)


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Which of the bit-sliced numbers are above the radius."""
    more, same = np.zeros_like(counter[0]), np.full_like(counter[0], 255)
    for k in range(len(counter) - 1, -1, -1):
        if radius >> k & 1:
            same = same & counter[k]
        else:
            more = more | (same & counter[k])
            same = same & ~counter[k]
    return more


def _near(planes: np.ndarray, radius: int, wanted: np.ndarray, every: int = 12) -> np.ndarray:
    """Which of the wanted pairs (one bit each) differ in at most ``radius`` of their planes.

    Three planes at a time go into the bit-sliced counters as a sum and a carry;
    a block of pairs is left once all wanted ones of it are beyond the radius.
    """
    out = np.zeros_like(wanted)
    width = max(2, len(planes).bit_length())
    step = BLOCK // 8
    for at in range(0, planes.shape[1], step):
        part, want = planes[:, at : at + step], wanted[at : at + step]
        if not want.any():
            continue
        counter = [np.zeros(part.shape[1], dtype=np.uint8) for _ in range(width)]

        def add(carry: np.ndarray, level: int, counter: list[np.ndarray] = counter) -> None:
            while level < width and carry.any():
                counter[level], carry = counter[level] ^ carry, counter[level] & carry
                level += 1

        for k in range(0, len(part) - 2, 3):
            a, b, c = part[k : k + 3]
            half = a ^ b
            add(half ^ c, 0)
            add((a & b) | (half & c), 1)
            if k % every == 0 and k >= 2 * radius and not (want & ~_above(counter, radius)).any():
                break
        else:
            for plane in part[len(part) - len(part) % 3 :]:
                add(plane, 0)
            out[at : at + step] = want & ~_above(counter, radius)
    return out


def within(different: np.ndarray, radius: int) -> np.ndarray:
    """Which of (pairs x lanes) differences have at most ``radius`` bits."""
    out = np.zeros(len(different), dtype=bool)
    for at in range(0, len(different), BLOCK):
        part = different[at : at + BLOCK]
        found = _near(_planes(part), radius, np.packbits(np.ones(len(part), dtype=bool)))
        out[at : at + len(part)] = np.unpackbits(found)[: len(part)].astype(bool)
    return out


def _forest(prints: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links that join what the radius joins inside a large bucket: each reached class is compared with those not reached.

    The bucket's bit planes are stored vertically once; a probe turns over the
    planes in which it has a bit, and what is left of them are the differences.
    They are packed anew when half of the classes have been reached.
    """
    left, right, rest = [], [], np.arange(len(prints))
    frontier: list[int] = []
    while len(rest):
        planes = np.concatenate([_planes(prints[rest[at : at + BLOCK]]) for at in range(0, len(rest), BLOCK)], axis=1)
        open_bits = np.packbits(np.ones(len(rest), dtype=bool))
        number = enough = len(rest)
        while number and 2 * number > enough:
            if not frontier:
                seed = int(np.argmax(np.unpackbits(open_bits)))
                open_bits[seed >> 3] &= 0xFF ^ (0x80 >> (seed & 7))
                frontier, number = [int(rest[seed])], number - 1
                continue
            probe = frontier.pop()
            own = np.unpackbits(np.ascontiguousarray(prints[probe]).view(np.uint8))
            found = _near(planes ^ (own * np.uint8(0xFF))[:, None], radius, open_bits)
            open_bits &= ~found
            near = rest[np.flatnonzero(np.unpackbits(found)[: len(rest)])].tolist()
            number -= len(near)
            frontier += near
            left += [probe] * len(near)
            right += near
        rest = rest[np.flatnonzero(np.unpackbits(open_bits)[: len(rest)])]
    return left, right


def _finer(prints: np.ndarray, radius: int) -> list[np.ndarray] | None:
    """Masks of finer tables for a large bucket, over the bits that differ in it: they miss no pair of it within the radius.  None if there is nothing to gain."""
    spread = np.bitwise_or.reduce(prints ^ prints[0], axis=0)
    bits = np.flatnonzero(np.unpackbits(spread.view(np.uint8), bitorder="little"))
    if radius > 8 or len(bits) <= 2 * radius:
        return None
    need = math.log2(len(prints) / SMALL)
    free = next((c for c in (1, 2) if c * len(bits) / (radius + c) >= need), 3)
    blocks = np.array_split(bits, radius + free)
    out = []
    for chosen in itertools.combinations(blocks, free):
        mask = np.zeros(64 * prints.shape[1], dtype=np.uint8)
        mask[np.concatenate(chosen)] = 1
        out.append(np.packbits(mask, bitorder="little").view(np.uint64))
    return out


def _in_buckets(prints: np.ndarray, key: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (places) that join what the radius joins inside each run of equal keys."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for n in range(2, SMALL + 1):
        at = starts[sizes == n]
        i, j = np.triu_indices(n, 1)
        a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
        near = within(prints[a] ^ prints[b], radius)
        left.append(a[near])
        right.append(b[near])
    for at, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        here = prints[at : at + n]
        masks = _finer(here, radius) if n > SPLIT else None
        if masks is None:
            a, b = _forest(here, radius)
            left.append(np.array(a, dtype=np.int64) + at)
            right.append(np.array(b, dtype=np.int64) + at)
            continue
        for mask in masks:
            finer = np.zeros(n, dtype=np.uint64)
            for lane in range(here.shape[1]):
                finer = mix64(finer + (here[:, lane] & mask[lane]))
            order = np.argsort(finer, kind="stable")
            a, b = _in_buckets(here[order], finer[order], radius)
            left.append(order[a] + at)
            right.append(order[b] + at)
    return np.concatenate(left), np.concatenate(right)


def _compare(lanes: int, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["key"], 200_000):
            ids = table.column("rep").to_numpy()
            prints = np.stack([table.column(f"f{k}").to_numpy() for k in range(lanes)], axis=1).view(np.uint64)
            a, b = _in_buckets(prints, table.column("key").to_numpy(), radius)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(ids[a], ids[b])), pa.array(np.minimum(ids[a], ids[b]))], names=["u", "v"])

    return run


def links(classes: DataFrame, lanes: int, radius: int, tables: list[Table]) -> DataFrame:
    """``u, v`` (u > v): links between class representatives ``rep`` that the tables' buckets show."""
    prints = [f"f{k}" for k in range(lanes)]
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), *[F.lit(m).cast("long").alias(f"m{k}") for k, m in enumerate(masks)]) for t, masks in enumerate(tables)]))
    placed = classes.select("rep", *prints, table.alias("__t"))
    key = F.xxhash64("__t.t", *[F.col(f).bitwiseAND(F.col(f"__t.m{k}")) for k, f in enumerate(prints)])
    placed = placed.select(key.alias("key"), "rep", *prints)
    dealt = placed.repartition(partitions(classes.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(lean(_compare(lanes, radius)), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``u, component``: for every linked node the smallest node it reaches, itself included.

    Alternates large and small stars until every node hangs on its component's
    minimum; the number of rounds grows with the logarithm of the longest path.
    """
    edges = cut(edges.select("u", "v"))
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        before, edges = edges, cut(small)
        discard(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            return edges.groupBy("u").agg(F.min("v").alias("component"))
        state = now


def groups(docs: DataFrame, shingle: int = 4, lanes: int = 1, radius: int = 4, agree: float | None = None, recall: float = 0.97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, f0 .., component_id`` for every row: documents linked directly or over others share a component, the smallest id of it.

    ``agree`` None: exact tables.  Otherwise sampled tables that find pairs
    agreeing on that share of bits with probability ``recall``.
    """
    prints = [f"f{k}" for k in range(lanes)]
    found = cut(fingerprints(docs, shingle, lanes, id_col, text_col))
    classes = cut(found.where("doc_id is not null").groupBy(*prints).agg(F.min("doc_id").alias("rep")))
    number = classes.count()
    tables = exact_tables(radius, number, 64 * lanes) if agree is None else sampled_tables(agree, number, 64 * lanes, recall)
    joined = components(links(classes, lanes, radius, tables))
    labelled = classes.join(joined, classes.rep == joined.u, "left").select(*[F.col(f).alias(f"__{f}") for f in prints], F.coalesce("component", "rep").alias("component_id"))
    same = [F.col(f) == F.col(f"__{f}") for f in prints]
    return found.join(labelled, same, "left").select("doc_id", *prints, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _distinct(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes of each text, in order, and how many each text has."""
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    first = np.ones(len(row), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[first], np.bincount(row[first], minlength=len(counts))


def _digests(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64 bits that stand for each text's set of hashes, as signed longs."""
    ends = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix64(hashes))])
    stops = np.cumsum(counts)
    return (ends[stops] - ends[stops - counts]).view(np.int64)


def least_hashes(hashes: np.ndarray, counts: np.ndarray, tables: int) -> np.ndarray:
    """(texts x tables) keys of ``ROWS`` least hashes each: texts of similarity s share one with probability s ** ROWS, whatever the corpus."""
    out = np.zeros((len(counts), tables), dtype=np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
        draw = random.Random(SEED)
        for t in range(tables):
            key = np.full(len(some), t, dtype=np.uint64)
            for _ in range(ROWS):
                mixed = (hashes ^ np.uint64(draw.getrandbits(64))) * np.uint64(draw.getrandbits(64) | 1)
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(mixed ^ (mixed >> np.uint64(32)), starts))
            out[some, t] = key
    return out


def least_tables(similarity: float, recall: float) -> int:
    """How many tables of least hashes bring a pair of that similarity together with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**ROWS))


def sketches(rows: DataFrame, shingle: int, lanes: int, tables: int) -> DataFrame:
    """Rows ``home, print, doc_id, text`` as ``home, print, doc_id, f0 .., node, size, keys``: fingerprints over the different shingles of each text, what stands for their set, their number, and the set's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in chunks(batch, "text", 1 << 20):
                hashes, counts = _distinct(*_shingles([t or b"" for t in some.column(3).to_pylist()], shingle))
                prints = [majority(hashes if k == 0 else mix64(hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), counts) for k in range(lanes)]
                keys = least_hashes(hashes, counts, tables)[counts > 0].view(np.int64)  # no words, no keys
                ends = np.concatenate([[0], np.cumsum((counts > 0) * tables)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel()))
                made = [*(pa.array(p.view(np.int64)) for p in prints), pa.array(_digests(hashes, counts)), pa.array(counts.astype(np.int64)), lists]
                yield pa.RecordBatch.from_arrays([*some.columns[:3], *made], names=["home", "print", "doc_id", *(f"f{k}" for k in range(lanes)), "node", "size", "keys"])

    return rows.mapInArrow(lean(run), "home long, print long, doc_id long, " + ", ".join(f"f{k} long" for k in range(lanes)) + ", node long, size long, keys array<long>")


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """Rows ``text, node, group`` as ``group, node, shingles``: the different shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in chunks(batch, "text", 1 << 20):
                hashes, counts = _distinct(*_shingles([t or b"" for t in some.column(0).to_pylist()], shingle))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([some.column(2), some.column(1), lists], names=["group", "node", "shingles"])

    return rows.select("text", "node", "group").mapInArrow(lean(run), "group long, node long, shingles array<long>")


def joined(tokens: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """For each set of tokens the first set that it reaches over pairs of this Jaccard similarity.

    Sets of that similarity share one of their rarest tokens (as many as either
    may lack of the other, and one), so only sets that do are compared.  A set
    is compared with those not reached yet.
    """
    n = len(counts)
    root = np.arange(n)
    _, at, often = np.unique(tokens, return_inverse=True, return_counts=True)
    rank = np.empty(len(often), dtype=np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    row, token = np.repeat(np.arange(n), counts), rank[at]
    token = token[np.lexsort((token, row))]
    starts = np.concatenate([[0], np.cumsum(counts)])
    first = counts - np.ceil(similarity * counts - 1e-9).astype(np.int64) + 1
    early = np.arange(len(token)) - starts[row] < first[row]
    order = np.argsort(token[early], kind="stable")
    held = row[early][order]
    where = np.concatenate([[0], np.cumsum(np.bincount(token[early], minlength=len(often)))])
    member, left = np.zeros(len(often), dtype=bool), np.ones(n, dtype=bool)
    shared = np.flatnonzero(np.diff(where) > 1)
    alone = np.ones(n, dtype=bool)
    alone[held[np.isin(token[early][order], shared)]] = False
    left[alone] = False  # no token in common with any other
    for seed in np.flatnonzero(~alone).tolist():
        if not left[seed]:
            continue
        left[seed] = False
        reached = [seed]
        while reached:
            x = reached.pop()
            mine = token[starts[x] : starts[x + 1]]
            near = np.concatenate([held[where[t] : where[t + 1]] for t in mine[: first[x]].tolist()])
            near = np.unique(near[left[near]])
            near = near[(counts[near] >= similarity * counts[x] - 1e-9) & (similarity * counts[near] - 1e-9 <= counts[x])]
            if not len(near):
                continue
            member[mine] = True
            sizes = counts[near]
            ends = np.cumsum(sizes)
            flat = np.arange(ends[-1]) + np.repeat(starts[near] - (ends - sizes), sizes)
            both = np.add.reduceat(member[token[flat]].astype(np.int64), ends - sizes)
            member[mine] = False
            found = near[both / (sizes + counts[x] - both) >= similarity]
            left[found] = False
            root[found] = seed
            reached += found.tolist()
    return root


def _verify(similarity: float):
    """``u, v`` (u > v): what joins the nodes of a group whose sets have the similarity, directly or over others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in runs(batches, ["group"], LOT):
            lists = lot.column("shingles").combine_chunks()
            counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            node, group = lot.column("node").to_numpy(), lot.column("group").to_numpy()
            # a shingle counts for its own group only
            tokens = lists.flatten().to_numpy().view(np.uint64) ^ mix64(np.repeat(group, counts).view(np.uint64))
            root = joined(tokens, counts, similarity)
            least = np.full(len(node), np.iinfo(np.int64).max)
            np.minimum.at(least, root, node)
            u, v = node, least[root]
            yield pa.RecordBatch.from_arrays([pa.array(u[u > v]), pa.array(v[u > v])], names=["u", "v"])

    return run


def _labels(rows: DataFrame, shingle: int, lanes: int, radius: int, recall: float, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(sketches of the rows, ``node, least, label`` of the different texts' sets): sets of one label are joined by the similarity.

    Sets meet in tables of least hashes, and those within the radius are
    candidates.  A bucket shows a forest of them; what the forests join holds
    every candidate pair, and inside it the similarity is exact.  Of large ones
    the sets are dealt to parts, each two of which meet in a task.
    """
    spark, prints = rows.sparkSession, [f"f{k}" for k in range(lanes)]
    n = partitions(spark)
    found = cut(sketches(rows, shingle, lanes, least_tables(similarity, recall)))
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "home", "print")
    classes = cut(found.groupBy("node").agg(F.min(least).alias("least"), *[F.first(c).alias(c) for c in [*prints, "size", "keys"]]))
    placed = classes.select(F.explode("keys").alias("key"), F.col("node").alias("rep"), *prints).repartition(n, "key").sortWithinPartitions("key", "rep")
    candidates = components(placed.mapInArrow(lean(_compare(lanes, radius)), "u long, v long").distinct())
    labels = cut(candidates.unionByName(candidates.select(F.col("component").alias("u"), "component").distinct()))
    members = cut(classes.select("node", "least", "size").join(labels.withColumnRenamed("component", "label"), F.col("node") == F.col("u")).drop("u"))
    parts = members.groupBy("label").agg(F.ceil(F.sum("size") / F.lit(LARGE)).cast("int").alias("parts"))
    some = members.join(parts, "label").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    group = F.xxhash64("label", F.least("own", "other"), F.greatest("own", "other"))
    some = some.select(F.col("least.home").alias("__home"), F.col("least.print").alias("__print"), "node", group.alias("group"))
    texts = rows.join(some, (F.col("home") == F.col("__home")) & (F.col("print") == F.col("__print")))
    sets = shingle_sets(texts, shingle).dropDuplicates(["group", "node"]) if found.count() > classes.count() else shingle_sets(texts, shingle)
    links = cut(sets.repartition(n, "group").sortWithinPartitions("group", "node").mapInArrow(lean(_verify(similarity)), "u long, v long"))
    # a label in one part is joined there; over more parts links are joined once more
    whole = parts.where("parts > 1").isEmpty()
    joins = links.select("u", F.col("v").alias("component")) if whole else components(links)
    label = F.coalesce("component", "node").alias("label")
    return found, cut(classes.join(joins, F.col("node") == F.col("u"), "left").select("node", "least", label))


def _rows(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns with ``home, print``, which tell rows apart that are not equal in all of them, and ``doc_id, text`` as operators take them."""
    rows = pick(docs, *columns)
    rows = rows.select(*[F.col(c).alias(f"__{c}") for c in columns])
    number = F.col("__doc_id").cast("long")
    return rows.withColumns({"home": F.coalesce(number, F.lit(0).cast("long")), "print": F.xxhash64(*[x for c in columns for x in (F.col(f"__{c}").isNull(), F.col(f"__{c}"))]), "doc_id": number, "text": F.col("__text").cast("binary")})


def similar(docs: DataFrame, shingle: int, lanes: int, radius: int, recall: float, similarity: float) -> DataFrame:
    """``doc_id, component_id`` for every row: documents whose sets of shingles have the Jaccard similarity, directly or over others, share a component, the smallest id of it (a null id: null)."""
    found, labelled = _labels(_rows(docs, ("doc_id", "text")).select("home", "print", "doc_id", "text"), shingle, lanes, radius, recall, similarity)
    least = labelled.groupBy("label").agg(F.min("least")["doc_id"].alias("component_id"))
    return found.join(labelled.join(least, "label").select("node", "component_id"), "node", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, columns: tuple[str, ...], shingle: int, lanes: int, radius: int, recall: float, similarity: float) -> DataFrame:
    """The columns of one row of each group that ``similar`` joins: that with the smallest id (null last; of equal rows any one)."""
    rows = _rows(docs, columns)
    found, labelled = _labels(rows.select("home", "print", "doc_id", "text"), shingle, lanes, radius, recall, similarity)
    best = labelled.groupBy("label").agg(F.min("least").alias("best")).select(F.col("best.home").alias("__h"), F.col("best.print").alias("__p"))
    again = found.groupBy("home", "print").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = rows.drop("doc_id", "text").join(best, (F.col("home") == F.col("__h")) & (F.col("print") == F.col("__p"))).drop("__h", "__p")
    if not again.isEmpty():
        both = ["home", "print"]
        kept = kept.join(again.select(*both), both, "left_anti").unionByName(kept.join(again.select(*both), both, "left_semi").dropDuplicates(both))
    return kept.select(*[F.col(f"__{c}").alias(c) for c in columns])


def hexadecimal(lane) -> F.Column:
    """16 lowercase hex digits of a fingerprint's lane."""
    return F.lpad(F.lower(F.hex(lane)), 16, "0")
