"""Media columns: payloads stored as PNG images, read back, checked and hashed.

``encode`` writes a payload as an 8-bit grey image of ``WIDTH`` samples a row:
signature, IHDR, one zlib stream in IDAT, IEND, each chunk with its CRC-32.  A
row is filtered by whichever of None, Sub and Up has the least sum of absolute
differences.  ``decode`` walks the chunks, tests every checksum, inflates, and
undoes the filters with numpy (all five of the format).  ``cosine_hash`` shrinks
the image by block means, takes its low-frequency cosine transform in integers
(so that equal images agree to the bit on any machine) and sets a bit for each
coefficient above their median.

Inputs: a null payload counts as empty; padding makes an image of one row at
least; broken images raise ``ValueError`` in ``decode`` and give a null payload
and hash, with the error's text, in ``read``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, pick, prepare

WIDTH = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE, LOW = 32, 8
#: Cosines of the transform as integers of 14 bits.
COSINE = np.rint(np.cos(np.pi / SIDE * np.outer(np.arange(LOW), np.arange(SIDE) + 0.5)) * (1 << 14)).astype(np.int64)


def pad(payload: bytes, width: int = WIDTH) -> bytes:
    """Spaces up to a positive multiple of ``width``."""
    return payload.ljust(max(1, -(-len(payload) // width)) * width, b" ")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes, width: int = WIDTH, level: int = 3) -> bytes:
    """A PNG whose samples are the payload; its length is a positive multiple of ``width``."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, width)
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    filtered = np.stack([rows, sub, up])
    kind = np.abs(filtered.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
    lines = np.empty((len(rows), width + 1), dtype=np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = filtered[kind, np.arange(len(rows))]
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _diagonals(kind: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Undoes any mix of filters along the image's diagonals: a sample needs those to its left and above, which are one or two diagonals before."""
    height, width = out.shape
    done = np.zeros((height + 1, width + 1), dtype=np.int16)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height - 1, d) + 1)
        x = d - y
        a, b, c = done[y + 1, x], done[y, x + 1], done[y, x]
        p = a + b - c
        pa, pb, pc_ = np.abs(p - a), np.abs(p - b), np.abs(p - c)
        near = np.where((pa <= pb) & (pa <= pc_), a, np.where(pb <= pc_, b, c))
        done[y + 1, x + 1] = (out[y, x] + np.choose(kind[y], (np.zeros_like(a), a, b, (a + b) >> 1, near))) & 255
    return done[1:, 1:].astype(np.uint8)


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Samples of filtered lines of one-byte pixels, whose first column is the filter."""
    kind, out = lines[:, 0], lines[:, 1:].copy()
    if kind.size and kind.max() > 4:
        raise ValueError("unknown filter")
    if (kind >= 3).any():
        return _diagonals(kind, out)
    sub = kind == 1
    out[sub] = np.cumsum(out[sub], axis=1, dtype=np.uint64).astype(np.uint8)
    for y in np.flatnonzero(kind == 2).tolist():
        if y:
            out[y] += out[y - 1]
    return out


def decode(image: bytes) -> np.ndarray:
    """The samples (height x width) of an 8-bit grey PNG without interlacing."""
    if image[:8] != SIGNATURE:
        raise ValueError("no signature")
    at, header, data, ended = 8, None, [], False
    while at < len(image) and not ended:
        if at + 12 > len(image):
            raise ValueError("chunk cut short")
        (n,) = struct.unpack(">I", image[at : at + 4])
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if len(image) < at + 12 + n or struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if header is None or not ended or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit grey image")
    width, height = header[:2]
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != height * (width + 1):
        raise ValueError("wrong number of samples")
    return unfilter(np.frombuffer(raw, dtype=np.uint8).reshape(height, width + 1))


def _shrink(samples: np.ndarray, axis: int) -> np.ndarray:
    """Block sums scaled to means of 8 more bits; short axes repeat their samples."""
    n = samples.shape[axis]
    if n < SIDE:
        return np.take(samples, np.arange(SIDE) * n // SIDE, axis=axis)
    edges = np.arange(SIDE) * n // SIDE
    shape = [1, 1]
    shape[axis] = SIDE
    return np.add.reduceat(samples, edges, axis=axis) // np.diff(np.append(edges, n)).reshape(shape)


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which low-frequency coefficients lie above their median."""
    small = _shrink(_shrink(samples.astype(np.int64) << 8, 0), 1)
    low = (COSINE @ small @ COSINE.T).ravel()
    return np.packbits(low > np.sort(low[1:])[(LOW * LOW - 1) // 2]).tobytes()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text as a PNG in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                texts = [t or b"" for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(pad(t, width), width) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("binary"))
    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def read(media: DataFrame) -> DataFrame:
    """Adds ``payload`` (binary), ``hash`` (binary) and ``error`` from column ``media``, read back from the stored bytes."""
    from pyspark.sql import types as T

    prepare(media.sparkSession)
    schema = T.StructType([*media.schema.fields, T.StructField("payload", T.BinaryType()), T.StructField("hash", T.BinaryType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                payload, hashes, errors = [], [], []
                for image in some.column(some.schema.get_field_index("media")).to_pylist():
                    try:
                        samples = decode(image or b"")
                        found = samples.tobytes(), cosine_hash(samples), None
                    except ValueError as e:
                        found = None, None, str(e)
                    for to, x in zip((payload, hashes, errors), found, strict=True):
                        to.append(x)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(payload, pa.binary()), pa.array(hashes, pa.binary()), pa.array(errors, pa.string())], names=[*some.schema.names, "payload", "hash", "error"])

    return media.mapInArrow(lean(run), schema)
