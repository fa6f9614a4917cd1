"""Vectorised word kernels over Arrow string batches.

Every helper works on the contiguous UTF-8 buffer of one Arrow batch, so the
per-word work happens inside numpy.  A *word* is a maximal run of bytes other
than space and the five ASCII controls 9 to 13; UTF-8 continuation bytes are
never separators, so the byte view and the character view agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), for uint64 arrays."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX2
    return x ^ (x >> np.uint64(33))


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    k, step = 1, base
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(step)
        step = step * step % (1 << 64)
        k += m
    return out


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up = _powers(int(_BASE), size)
            self.down = _powers(_inverse(int(_BASE)), size)
        return self.up, self.down


_POWERS = _Powers()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


class Words:
    """Word spans of a batch: ``start``/``end`` byte positions, and ``first``, where ``first[i]:first[i+1]`` are the words of row i."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray | None = None) -> None:
        n = len(raw)
        self.raw, self.offsets = raw, offsets
        word = ~(SPACE[raw] if gap is None else gap)
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        stop = word.copy()
        stop[:-1] &= ~word[1:]
        # a row's end splits words too
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        begin[cuts] = word[cuts]
        stop[cuts - 1] = word[cuts - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word, a function of its bytes alone."""
        if not len(self):
            return np.empty(0, dtype=np.uint64)
        up, down = _POWERS.get(len(self.raw) + 1)
        total = np.zeros(len(self.raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODE[self.raw] * up[: len(self.raw)], out=total[1:])
        return mix64((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def words_of(column: pa.Array) -> Words:
    return Words(*utf8(column))


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` consecutive words from each position (the caller cuts those that cross a row's end)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out * _BASE + hashes[k : k + n]
    return mix64(out)


def chunks(batch: pa.RecordBatch, text: str, limit: int = 8 << 20):
    """Slices of a batch whose texts hold about ``limit`` bytes at most, one row at least: bounds the kernels' memory."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    total, begin = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(size)
    if begin < len(sizes):
        yield batch.slice(begin)
