"""Packing documents into training sequences by best-fit decreasing.

A document becomes its token ids and an end id.  Whole windows are cut from an
overlong document first, each a sequence of its own that needs no placing; what
is left of it is placed, longest first, into the open sequence with the least
room that still fits it.  Remainders are dealt by their number to groups of
about ``group_docs`` (a parameter that bounds a task's memory; a group wastes
less than about one sequence), so packing shuffles a few numbers a document.

Inputs: a null text counts as empty, a document of the end id alone; repeated
rows, equal ones and ones with null ids too, are dealt and packed each for
itself; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, pick

WINDOW = 2048
END_ID = 1
GROUP_DOCS = 32_768

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = PIECES + ", sequence_id long, offset long"

#: Texts of these characters alone are split here, and a word's ids looked up; all others go to the tokenizer whole.
PLAIN = r"[\t\n\r\x20-\x7e¡-§©«-¬°-±¶-·»¿-ÖØ-öø-ÿ]*"
#: The word pattern of the vocabulary file, over those characters; what most words are is tried first.
PIECE = r"[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9ß-öø-ÿ]+"


class Words(dict):
    """Ids of words, with an older table behind it whose words move on when they are seen again.

    A word that neither has gets room in ``new``, still empty: a text's ids are
    looked up once, and those of its new words come before they are joined.
    """

    def __init__(self, older: dict[str, bytes]) -> None:
        self.older = older
        self.new: dict[str, bytearray] = {}

    def __missing__(self, word: str) -> bytes | bytearray:
        ids = self.older.get(word)
        if ids is None:
            return self.new.setdefault(word, bytearray())
        self[word] = ids
        return ids


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes.

    A batch's words are looked up, and the new ones encoded together.  Words are
    kept in two tables of half the bounded number (about 200 bytes a word): one
    that is full after a batch takes the place of the older.
    """

    def __init__(self, path: str, end_id: int, limit: int = 400_000) -> None:
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for words that are split and lower-cased here
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.end = np.array([end_id], dtype="<u4").tobytes()
        self.plain = re.compile(PLAIN).fullmatch
        self.split = re.compile(PIECE).findall
        self.limit = limit
        self.known = Words({})

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of single words, encoded as one text: a space keeps words apart, and the vocabulary marks a word's last id."""
        ids = np.array(self.bare.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = 4 * (np.flatnonzero(self.last[ids]) + 1)
        if len(ends) != len(words):
            return self._ids(words)
        data = ids.tobytes()
        cuts = [0, *ends.tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        known.new = {}
        found = [None if "<|" in text or not self.plain(text) else list(map(known.__getitem__, self.split(text.lower()))) for text in texts]
        if known.new:
            ids = self._words(list(known.new))
            for room, word in zip(known.new.values(), ids, strict=True):
                room += word
            known.update(zip(known.new, ids, strict=True))
        out = [(self._ids([text])[0] if words is None else b"".join(words)) + self.end for text, words in zip(texts, found, strict=True)]
        if len(known) > self.limit // 2:
            known.older, known.new = {}, {}
            self.known = Words(known)
        return out


def cut_lengths(tokens: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of whole windows and of what is left."""
    return [(s, min(window, tokens - s)) for s in range(0, tokens, window)]


#: A Python worker's encoders, kept for its later tasks.
_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _pieces(path: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _ENCODERS.get((path, end_id)) or _ENCODERS.setdefault((path, end_id), Encoder(path, end_id))
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                some = batch.slice(part, 256)
                ids, rows = some.column(0).to_pylist(), []
                for doc, data in zip(ids, encoder.encode([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    n = len(data) // 4
                    for s, k in cut_lengths(n, window):
                        rows.append((doc, s, k, zlib.crc32(data[4 * s : 4 * (s + k)]), n, number))
                        number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "number"])

    return run


class Rooms:
    """A segment tree over remaining capacities: the open windows of each capacity, and the least capacity that fits."""

    def __init__(self, window: int) -> None:
        self.half = 1 << window.bit_length()
        self.count = [0] * (2 * self.half)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        node = self.half + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The open window with the least room of ``need`` or more, removed; of equal ones the last opened."""
        node = self.half + need
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.half:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.half
        sequence = self.open[room].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, sequence


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) for each length, in the order given, longest first."""
    rooms, opened = Rooms(window), 0
    sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    for i, n in enumerate(lengths.tolist()):
        found = rooms.take(n)
        if found is None:
            found = window, opened
            opened += 1
        room, at = found
        sequence[i], offset[i] = at, window - room
        if room > n:
            rooms.add(room - n, at)
    return sequence, offset


def _place(window: int):
    def run(table: pa.Table) -> pa.Table:
        group = table.column("__group")[0].as_py()
        table = table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = best_fit(table.column("length").to_numpy(), window)
        return table.append_column("sequence_id", pa.array(sequence + (group << 32))).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, group_docs: int = GROUP_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.  ``tokenizer`` is the vocabulary file's path on every executor."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    pieces = cut(rows.mapInArrow(lean(_pieces(tokenizer, window, end_id)), PIECES + ", number long"))
    full, rest = pieces.where(F.col("length") == window), pieces.where(F.col("length") < window)
    alone = full.withColumn("sequence_id", F.col("number") + F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("long")).drop("number")
    groups = max(1, -(-rest.count() // group_docs))
    return alone.unionByName(rest.withColumn("__group", F.pmod(F.xxhash64("number"), F.lit(groups))).groupBy("__group").applyInArrow(_place(window), PLACED))
