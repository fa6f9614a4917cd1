"""Nearest neighbours by inner product with randomly rotated one-bit codes.

A vector is divided by its length, padded to whole 64-bit words and rotated;
its code is the signs.  With ``x`` the unit vector of the signs and ``c`` its
inner product with the rotated vector, ``<x, q> / c`` estimates the vector's
inner product with a rotated query ``q``, and its error is about
``|q| sqrt((1 - c^2) / c^2) / sqrt(D - 1)``.  Queries are rounded to
``QUERY_BITS`` bits, so that ``<x, q>`` is a few counts of common bits in packed
words.  In each block of vectors the best by estimate are reranked first; all
whose upper bound reaches the k-th best inner product found so are reranked
too.  Reranking takes the original vectors in double precision, and what may
still be among the best is summed in the order of the components.

Every vector is indexed; nothing is fitted.  Queries and vectors meet in
blocks of bounded size, and a block is copied once for each lot of queries.

Inputs: vectors that are null, empty or zero, or hold null or non-finite
components, are neither queries nor candidates; a query's candidates are all
other rows of its own dimension, also rows that repeat its id or have a null
id (which are candidates, never queries); each row of a repeated query id has
ranks of its own; equal scores go to the smaller id, a null id last; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pick

NEIGHBOURS = 20
EVERY = 20
BLOCK = 8192
QUERIES = 16_384
QUERY_BITS = 6
#: Multiples of the error's scale that the bounds allow.
CONFIDENCE = 3.0
#: Vectors of a block that are reranked whatever their bounds.
LEAD = 64
SEED = 7


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix for vectors padded to ``dim``."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def padded(dim: int) -> int:
    return -(-dim // 64) * 64


def codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs as uint64 words, lengths, inner products of signs and vector) of n x dim vectors."""
    norm = np.linalg.norm(vectors, axis=1)
    wide = padded(vectors.shape[1])
    turned = (vectors / norm[:, None]) @ rotation_of(wide)[: vectors.shape[1]]
    bits = turned > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64), norm, np.abs(turned).sum(axis=1) / np.sqrt(wide)


class Coded:
    """A block's codes and scalars, its packed words stored one after the other."""

    def __init__(self, packed: np.ndarray, norm: np.ndarray, fit: np.ndarray) -> None:
        self.wide = 64 * packed.shape[1]
        self.words = np.ascontiguousarray(packed.T)
        self.ones = np.bitwise_count(packed).sum(axis=1, dtype=np.int64)
        self.scale = norm / np.sqrt(self.wide) / fit
        self.spread = CONFIDENCE * norm * np.sqrt(np.maximum(0.0, 1 - fit**2)) / fit / np.sqrt(max(1, self.wide - 1))
        self.rounding = CONFIDENCE * norm / np.sqrt(12) / fit

    def estimates(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimate, error bound) of a query's inner products, from codes and scalars alone."""
        turned = query @ rotation_of(self.wide)[: len(query)]
        low, high = turned.min(), turned.max()
        step = (high - low) / ((1 << QUERY_BITS) - 1) or 1.0
        levels = np.rint((turned - low) / step).astype(np.uint8)
        common = np.zeros(self.words.shape[1], dtype=np.int32)
        for k in range(QUERY_BITS):
            plane = np.packbits(levels >> k & 1, bitorder="little").view(np.uint64)
            for word, mask in zip(self.words, plane, strict=True):
                common += np.left_shift(np.bitwise_count(word & mask), k, dtype=np.int32)
        # sum over set bits of the rounded query, twice, less its whole sum
        signed = 2 * (low * self.ones + step * common) - (low * self.wide + step * int(levels.sum()))
        return self.scale * signed, np.sqrt(query @ query) * self.spread + step * self.rounding


_ROTATIONS: dict[int, np.ndarray] = {}


def rotation_of(dim: int) -> np.ndarray:
    if dim not in _ROTATIONS:
        _ROTATIONS[dim] = rotation(dim)
    return _ROTATIONS[dim]


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed component by component."""
    out = np.zeros(len(vectors))
    for j in range(len(query)):
        out += vectors[:, j] * query[j]
    return out


def kth(scores: np.ndarray, k: int) -> float:
    """The k-th greatest score, lowered by far more than summing in another order can change it."""
    if len(scores) < k:
        return -np.inf
    return np.partition(scores, -k)[-k] - 1e-9 * np.abs(scores).max()


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().astype(float, copy=False).reshape(-1, dim)


def _encode(table: pa.Table) -> pa.Table:
    """Adds codes and scalars to vectors of one block and dimension."""
    dim = table.column("dim")[0].as_py()
    packed, norm, code = codes(_matrix(table.column("vector"), dim))
    table = table.select(["at", "vec_id", "dim", "block", "vector"])
    return table.append_column("code", pa.array([row.tobytes() for row in packed], pa.binary())).append_column("norm", pa.array(norm)).append_column("fit", pa.array(code))


def _search(k: int):
    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        if queries.num_rows and block.num_rows:
            dim = block.column("dim")[0].as_py()
            at, vectors = block.column("at").to_numpy(), _matrix(block.column("vector"), dim)
            # null ids come after all others
            ids = block.column("vec_id").combine_chunks()
            ids, none = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
            packed = np.frombuffer(b"".join(block.column("code").to_pylist()), dtype=np.uint64).reshape(len(ids), -1)
            coded = Coded(packed, block.column("norm").to_numpy(), block.column("fit").to_numpy())
            places = np.arange(len(ids))
            for row, (own, query) in enumerate(zip(queries.column("at").to_numpy().tolist(), _matrix(queries.column("vector"), dim), strict=True)):
                estimate, error = coded.estimates(query)
                estimate[at == own] = -np.inf
                near = places[np.isfinite(estimate)] if len(places) <= max(k, LEAD) + 1 else None
                if near is None:
                    lead = np.argpartition(estimate, -max(k, LEAD))[-max(k, LEAD) :]
                    bar = kth(vectors[lead] @ query, k)
                    near = np.flatnonzero(estimate + error >= bar)
                if len(near) > k:
                    rough = (vectors @ query)[near] if 4 * len(near) > len(ids) else vectors[near] @ query
                    near = near[rough >= kth(rough, k)]
                score = exact(vectors[near], query)
                best = np.lexsort((ids[near], none[near], -score))[:k]
                found.append((row, near[best], score[best]))
        rows = np.concatenate([np.full(len(n), r) for r, n, _ in found]) if found else np.empty(0, np.int64)
        near = np.concatenate([n for _, n, _ in found]) if found else np.empty(0, np.int64)
        score = np.concatenate([s for _, _, s in found]) if found else np.empty(0)
        mine, theirs = queries.select(["at", "vec_id"]).take(pa.array(rows, pa.int64())), block.select(["vec_id"]).take(pa.array(near, pa.int64()))
        return pa.table([mine.column("at"), mine.column("vec_id"), theirs.column("vec_id"), pa.array(score, pa.float64())], names=["at", "query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, k: int = NEIGHBOURS, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of each vector whose id is divisible by ``every``."""
    vector = F.col("vector")
    rows = pick(vectors, vec_id=id_col, vector=vector_col).where("vector is not null").withColumn("vec_id", F.col("vec_id").cast("long"))
    if rows.schema["vector"].dataType.simpleString() not in ("array<float>", "array<double>"):
        rows = rows.withColumn("vector", F.transform(vector, lambda x: x.cast("double")))
    kind = rows.schema["vector"].dataType.simpleString()
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    # ``at`` tells rows apart; the table keeps the same numbers for all of its readers
    rows = cut(rows.where(F.coalesce(usable, F.lit(False))).withColumn("dim", F.size("vector")).withColumn("at", F.monotonically_increasing_id()))
    number = rows.count()
    blocks, lots = max(1, -(-number // BLOCK)), max(1, -(-number // every // QUERIES))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("at", F.lit("block")), F.lit(blocks)).cast("int"))
    index = rows.groupBy("dim", "block").applyInArrow(_encode, f"at long, vec_id long, dim int, block int, vector {kind}, code binary, norm double, fit double")
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("at", "vec_id", "dim", "vector", F.pmod(F.xxhash64("at", F.lit("lot")), F.lit(lots)).cast("int").alias("lot"))
    left = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("dim", "lot", "block")
    right = index.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))).groupBy("dim", "lot", "block")
    found = left.cogroup(right).applyInArrow(_search(k), "at long, query_id long, vec_id long, score double")
    order = Window.partitionBy("at").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
