"""Substring dedup with repeated-phrase automata.

A window is ``window`` consecutive words.  A window whose words also start in
a document with a smaller id is a repeat, and all words it covers go.

1. *Anchors.* A window's anchor is its word n-gram of least hash, so equal
   windows have equal anchors, and only about 2 in ``window - gram`` n-grams
   are one.  Anchors in two documents or more are counted; only the stretches
   around those go further.
2. *Passages.* The windows of one anchor make up a stretch of words.  Stretches
   are dealt to shards by anchor, equal ones of a batch of documents as one row
   with its places: document, text and word.
3. *Automata.* A shard confirms what recurs across documents, word by word: an
   anchor's only stretch as a whole, windows where an anchor has several.  It
   compiles that to an Aho-Corasick automaton (a word is a symbol) valued with
   the first document, and streams its documents' stretches through it to
   locate each occurrence.
4. *Documents.* Where an occurrence's first document is smaller than the
   document, its windows' words are removed.

A shard works through its anchors in bounded lots, for an anchor is in ``HOT``
documents at most.  The windows of anchors that are in more are known by
128-bit BLAKE2 digests instead: their first documents are aggregated before
and after a shuffle and joined to their places, which splits over tasks however
common a passage is.  The documents are shuffled once; the passes over them
share that exchange.

A document goes to the shards that own its anchors, not to all of them: no
other shard's automaton could find anything in it, and streaming everything
through everything would grow with the square of the corpus.

Inputs: null and empty texts have no words; a document of fewer words than a
window keeps them all; a null ``doc_id`` neither loses words nor makes others
lose any; rows that repeat a ``doc_id`` aren't repeats of each other; words
are told apart by their bytes, whatever their length; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, partitions, pick, runs
from .textkernel import _BASE, Words, chunks, gram_hashes, mix64, words_of

WINDOW = 13
GRAM = 5
#: Words of a shard's lot, about: its automaton stays within a processor's cache.
LOT = 40_000
CHUNK = 2 << 20
#: Documents beyond which an anchor's windows are dealt each by its own words.
HOT = 2_000


class Stretches:
    """The stretches of a batch: ``row``, ``begin``/``windows`` (word index, number of windows) and ``anchor`` (a 64-bit hash)."""

    def __init__(self, words: Words, window: int, gram: int) -> None:
        hashes = words.hashes()
        n = len(hashes) - window + 1
        empty = np.empty(0, dtype=np.int64)
        self.row = self.begin = self.windows = empty
        self.anchor = np.empty(0, dtype=np.uint64)
        if n <= 0:
            return
        grams = gram_hashes(hashes, gram)
        least, place = grams[:n].copy(), np.arange(n)
        for k in range(1, window - gram + 1):
            here = grams[k : k + n]
            less = here < least
            least[less] = here[less]
            place[less] = np.flatnonzero(less) + k
        rows = words.row_of()
        whole = np.flatnonzero(rows[:n] == rows[window - 1 :])
        if not len(whole):
            return
        new = np.ones(len(whole), dtype=bool)
        new[1:] = (place[whole][1:] != place[whole][:-1]) | (np.diff(whole) != 1)
        at = np.flatnonzero(new)
        self.begin = whole[at]
        self.windows = np.diff(np.append(at, len(whole)))
        self.row = rows[self.begin]
        self.anchor = least[self.begin]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _anchors(window: int, gram: int):
    """(anchor, doc_id) rows, each pair once a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in chunks(batch, "text", CHUNK):
                found = Stretches(words_of(some.column(1)), window, gram)
                order = np.lexsort((found.anchor, found.row))
                row, anchor = found.row[order], found.anchor[order]
                new = np.ones(len(row), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
                ids = some.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([_signed(anchor[new]), pa.array(ids[row[new]])], names=["anchor", "doc_id"])

    return run


#: Where a stretch is: document, hash of its text, word.
PLACE = np.dtype([("of", "<i8"), ("tag", "<i8"), ("begin", "<i4")])
#: A place with the windows from its word on that go, one bit each.  Marks travel many to a row, by the document's bucket.
MARK = np.dtype([*PLACE.descr, ("bits", "<i8")])
MARKS = "bucket long, marks binary"


class Recurring:
    """The stretches of a batch's named rows with a recurring anchor of their row; ``hot`` tells those of very common anchors."""

    def __init__(self, some: pa.RecordBatch, window: int, gram: int) -> None:
        some = some.filter(some.column(0).is_valid())
        self.words = words_of(some.column(1))
        self.window = window
        found = Stretches(self.words, window, gram)
        kept = np.flatnonzero(np.isin(self._pair(found.row, found.anchor), self._listed(some.column("anchors"))))
        self.row, self.begin, self.windows, self.anchor = (x[kept] for x in (found.row, found.begin, found.windows, found.anchor))
        self.hot = np.isin(self._pair(self.row, self.anchor), self._listed(some.column("hot")))
        self.ids, self.tags = some.column(0).to_numpy(), some.column("tag").to_numpy()

    @staticmethod
    def _pair(row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        # a hash of the pair is enough, for shards confirm by words
        return mix64(anchor ^ (row.astype(np.uint64) * _BASE))

    def _listed(self, lists: pa.Array) -> np.ndarray:
        offsets = np.asarray(lists.offsets)
        return self._pair(np.repeat(np.arange(len(lists)), np.diff(offsets)), lists.flatten().to_numpy().view(np.uint64))

    def texts(self, begin: np.ndarray, windows: np.ndarray) -> list[bytes]:
        """The stretches' words, joined by one space."""
        data, last = self.words.raw.tobytes(), begin + windows + self.window - 2
        return [b" ".join(data[a:b].split()) for a, b in zip(self.words.start[begin].tolist(), self.words.end[last].tolist(), strict=True)]

    def places(self, row: np.ndarray, begin: np.ndarray) -> np.ndarray:
        out = np.empty(len(row), dtype=PLACE)
        out["of"], out["tag"], out["begin"] = self.ids[row], self.tags[row], begin - self.words.first[row]
        return out


def _blobs(places: np.ndarray, lists: list[list[int]]) -> pa.Array:
    """A binary value for each list of places."""
    flat = places[np.fromiter((i for x in lists for i in x), dtype=np.int64)]
    ends = np.cumsum([0, *map(len, lists)]) * PLACE.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat.tobytes())])


def _stretches(window: int, gram: int):
    """(anchor, words, places) of recurring stretches, equal ones of a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in chunks(batch, "text", CHUNK):
                found = Recurring(some, window, gram)
                cold = ~found.hot
                if not cold.any():
                    continue
                groups: dict[tuple[int, bytes], list[int]] = {}
                for i, key in enumerate(zip(found.anchor[cold].view(np.int64).tolist(), found.texts(found.begin[cold], found.windows[cold]), strict=True)):
                    groups.setdefault(key, []).append(i)
                anchors, texts = zip(*groups, strict=True)
                places = _blobs(found.places(found.row[cold], found.begin[cold]), list(groups.values()))
                yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(texts, pa.binary()), places], names=["anchor", "words", "places"])

    return run


def _hot_windows(window: int, gram: int):
    """(print, least, most, places) of the windows of very common anchors, equal ones of a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in chunks(batch, "text", CHUNK):
                found = Recurring(some, window, gram)
                if not found.hot.any():
                    continue
                sizes = found.windows[found.hot]
                ends = np.cumsum(sizes)
                begin = np.arange(ends[-1]) + np.repeat(found.begin[found.hot] - (ends - sizes), sizes)
                places = found.places(np.repeat(found.row[found.hot], sizes), begin)
                groups: dict[bytes, list[int]] = {}
                for i, text in enumerate(found.texts(begin, np.ones(len(begin), np.int64))):
                    groups.setdefault(text, []).append(i)
                lists = list(groups.values())
                flat = places["of"][np.fromiter((i for x in lists for i in x), dtype=np.int64)]
                starts = np.cumsum([0, *map(len, lists)])[:-1]
                prints = [blake2b(t, digest_size=16).digest() for t in groups]
                yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(np.minimum.reduceat(flat, starts)), pa.array(np.maximum.reduceat(flat, starts)), _blobs(places, lists)], names=["print", "least", "most", "places"])

    return run


def _hot_marks(buckets: int):
    """Marks of windows with their ``owner``, in each document after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, owner = _unpack(batch.column(0), PLACE), batch.column(1).to_numpy()
            sizes = pc.binary_length(batch.column(0)).to_numpy() // PLACE.itemsize
            yield _packed(places[places["of"] > np.repeat(owner, sizes)], np.int64(1), buckets)

    return run


def _unpack(blobs: pa.Array, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x or b"" for x in blobs.to_pylist()), dtype=kind)


def _packed(places: np.ndarray, bits: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row of marks for each bucket of documents."""
    marks = np.empty(len(places), dtype=MARK)
    for c in PLACE.names:
        marks[c] = places[c]
    marks["bits"] = bits
    return _runs_of(marks, (mix64(marks["of"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), "bucket")


def _runs_of(marks: np.ndarray, key: np.ndarray, name: str) -> pa.RecordBatch:
    """Rows (key, its marks)."""
    order = np.argsort(key, kind="stable")
    key, data = key[order], marks[order].tobytes()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    ends = (np.append(first, len(key)) * MARK.itemsize).astype(np.int32)
    lists = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(key[first]), lists], names=[name, "marks"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(of, marks): one row a document, from rows sorted by bucket."""
    for some in runs(batches, ["bucket"], 256):
        marks = _unpack(some.column("marks").combine_chunks(), MARK)
        yield _runs_of(marks, marks["of"].astype(np.int64), "of")


def _locate(window: int, lot_words: int, buckets: int):
    """Confirms a lot's recurring windows, compiles them, streams the lot's stretches through the automaton, and marks their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        for lot in runs(batches, ["anchor"], max(1, lot_words // window)):
            blobs = lot.column("places").combine_chunks()
            places, sizes = _unpack(blobs, PLACE), pc.binary_length(blobs).to_numpy().astype(np.int64) // PLACE.itemsize
            starts = np.cumsum(sizes) - sizes
            # equal stretches of several batches are one from here on
            kinds: dict[tuple[int, bytes], int] = {}
            kind = np.array([kinds.setdefault(key, len(kinds)) for key in zip(lot.column("anchor").to_pylist(), lot.column("words").to_pylist(), strict=True)])
            least, most = np.full(len(kinds), np.iinfo(np.int64).max), np.full(len(kinds), np.iinfo(np.int64).min)
            np.minimum.at(least, kind, np.minimum.reduceat(places["of"], starts))
            np.maximum.at(most, kind, np.maximum.reduceat(places["of"], starts))
            numbers: dict[bytes, int] = {}
            texts = [[numbers.setdefault(w, len(numbers)) for w in text.split(b" ")] for _, text in kinds]
            # a symbol a word; two from disjoint alphabets where there are too many words for one
            wide = 1 if len(numbers) <= 0x100000 else 2
            symbol = [chr(0x10000 + i) if wide == 1 else chr(0x10000 + (i >> 19)) + chr(0x90000 + (i & 0x7FFFF)) for i in range(len(numbers))]
            lines = ["".join(map(symbol.__getitem__, text)) for text in texts]
            anchor = np.array([a for a, _ in kinds])
            other = np.concatenate([[True], anchor[1:] != anchor[:-1], [True]])
            alone = other[:-1] & other[1:]
            first, last = least.tolist(), most.tolist()
            automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
            step = wide * window
            for row in np.flatnonzero(alone & (least < most)).tolist():
                automaton.add_word(lines[row], (len(lines[row]) // wide - window, first[row]))
            seen: dict[str, tuple[int, int]] = {}
            for row in np.flatnonzero(~alone).tolist():
                line, lo, hi = lines[row], first[row], last[row]
                for k in range(0, len(line) - step + 1, wide):
                    phrase = line[k : k + step]
                    known = seen.get(phrase)
                    seen[phrase] = (lo, hi) if known is None else (min(lo, known[0]), max(hi, known[1]))
            for phrase, (lo, hi) in seen.items():
                if lo < hi:
                    automaton.add_word(phrase, (0, lo))
            if not len(automaton):
                continue
            automaton.make_automaton()
            hits: list[tuple[int, int, int]] = []  # stretch, window, first document
            for row, line in enumerate(lines):
                for end, (more, owner) in automaton.iter(line):
                    at = (end + 1) // wide - window
                    hits += [(row, k, owner) for k in range(at - more, at + 1)]
            if not hits:
                continue
            row, window_at, owner = (np.array(x, dtype=np.int64) for x in zip(*hits, strict=True))
            # each hit meets each place of its stretch
            place_kind = np.repeat(kind, sizes)
            order = np.argsort(place_kind, kind="stable")
            begins, counts = np.searchsorted(place_kind[order], row), np.bincount(place_kind, minlength=len(kinds))[row]
            ends = np.cumsum(counts)
            place = order[np.arange(ends[-1]) + np.repeat(begins - (ends - counts), counts)]
            later = places["of"][place] > np.repeat(owner, counts)
            bits = np.zeros(len(places), dtype=np.int64)
            np.bitwise_or.at(bits, place[later], np.int64(1) << np.repeat(window_at, counts)[later])
            some = np.flatnonzero(bits)
            yield _packed(places[some], bits[some], buckets)

    return run


def _remove(window: int, gram: int, keep: tuple[str, ...]):
    """Drops the marked windows' words: ``doc_id, n_words, n_removed, kept`` and the columns ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in chunks(batch, "text", CHUNK):
                words = words_of(some.column(1))
                cover = np.zeros(len(words) + 1, dtype=np.int32)
                marks = some.column("marks")
                if marks.null_count < len(marks):
                    flat, lengths = _unpack(marks, MARK), pc.fill_null(pc.binary_length(marks), 0).to_numpy(zero_copy_only=False) // MARK.itemsize
                    owner = np.repeat(np.arange(len(marks)), lengths)
                    # of rows that share an id each has its own marks
                    mine = flat["tag"] == some.column("tag").to_numpy()[owner]
                    at, bits = (words.first[owner] + flat["begin"])[mine], flat["bits"][mine].view(np.uint64)
                    for k in range(window - gram + 1):
                        begin = at[(bits >> np.uint64(k)) & np.uint64(1) == 1] + k
                        np.add.at(cover, begin, 1)
                        np.add.at(cover, begin + window, -1)
                gone = np.cumsum(cover)[:-1] > 0
                counts = words.counts()
                lost = np.add.reduceat(np.append(gone, False).astype(np.int64), words.first[:-1]) * (counts > 0) if len(counts) else counts
                data = words.raw.tobytes()
                kept = []
                for row in range(len(counts)):
                    if lost[row]:
                        a, b = words.first[row], words.first[row + 1]
                        left = np.flatnonzero(~gone[a:b]) + a
                        kept.append(b" ".join([data[s:e] for s, e in zip(words.start[left].tolist(), words.end[left].tolist(), strict=True)]))
                    else:
                        kept.append(b" ".join(data[words.offsets[row] : words.offsets[row + 1]].split()))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(counts.astype(np.int64)), pa.array(lost.astype(np.int64)), pa.array(kept, pa.binary()), *(some.column(c) for c in keep)], names=["doc_id", "n_words", "n_removed", "kept", *keep])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` and the columns ``keep`` for every row.

    ``kept`` (binary, UTF-8) holds the words that stay, joined by one space;
    columns of ``keep`` are carried through all passes, for a shuffle that
    leaves one out is another shuffle.
    """
    if not 0 < window - gram + 1 <= 63:
        raise ValueError("an anchor must have 1 to 63 windows")
    spark = docs.sparkSession
    n = partitions(spark)
    carried = [f"keep_{i}" for i in range(len(keep))]
    rows = pick(docs, doc_id=id_col, text=text_col, **dict(zip(carried, keep, strict=True)))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *carried)
    # rows without an id are dealt by their text; the column is never null, so that all uses of the exchange are alike
    tagged = rows.withColumn("tag", F.xxhash64("text"))
    dealt = tagged.withColumn("home", F.coalesce("doc_id", "tag")).repartition(n, "home")

    named = rows.where("doc_id is not null").select("doc_id", "text")
    anchors = named.mapInArrow(lean(_anchors(window, gram)), "anchor long, doc_id long").repartition(n, "anchor")
    often = anchors.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most").select("anchor", (F.col("n") > HOT).alias("hot"))
    both = anchors.join(often, "anchor").groupBy(F.col("doc_id").alias("of"))
    lists = cut(both.agg(F.collect_list("anchor").alias("anchors"), F.collect_list(F.when(F.col("hot"), F.col("anchor"))).alias("hot")))

    candidates = dealt.join(lists.hint("shuffle_hash"), F.col("home") == F.col("of")).select("doc_id", "text", "tag", "anchors", "hot", *carried)
    cold = candidates.mapInArrow(lean(_stretches(window, gram)), "anchor long, words binary, places binary").repartition(n, "anchor").sortWithinPartitions("anchor")
    buckets = 4 * n
    marks = cold.mapInArrow(lean(_locate(window, LOT, buckets)), MARKS)
    if not lists.where("size(hot) > 0").isEmpty():
        hot = candidates.where("size(hot) > 0").mapInArrow(lean(_hot_windows(window, gram)), "print binary, least long, most long, places binary")
        owners = hot.groupBy("print").agg(F.min("least").alias("owner"), F.max("most").alias("most")).where("owner < most").select("print", "owner")
        marks = marks.unionByName(hot.select("print", "places").join(owners, "print").select("places", "owner").mapInArrow(lean(_hot_marks(buckets)), MARKS))
    marks = marks.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_gather), "of long, marks binary")
    joined = dealt.join(marks, F.col("home") == F.col("of"), "left").select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), F.col("marks")).alias("marks"), "tag", *carried)
    extra = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carried)
    done = joined.mapInArrow(lean(_remove(window, gram, tuple(carried))), "doc_id long, n_words long, n_removed long, kept binary" + extra)
    return done.select("doc_id", "n_words", "n_removed", "kept", *[F.col(c).alias(k) for c, k in zip(carried, keep, strict=True)])
