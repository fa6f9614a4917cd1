"""Language identification: known words first, character n-grams for the rest.

A word that training saw scores with its per-language log frequency.  An
unseen word backs off to its character n-grams: the longest length of which
any is known decides, by the mean log frequency of those.  A document's scores
are its words' sums; all languages count as equally likely beforehand.  The
reported score is the posterior of the best language over at most ``SHARP``
words' worth of evidence.

Training reads a bounded sample: about ``per_lang`` documents a language,
chosen by the ids' hashes.  All words and n-grams of the sample are kept, as
sorted 64-bit hashes with the languages that have them.

Inputs: a null text, or one without a letter, is ``und`` with score 0; if
training has no language at all, everything is ``und``; equal scores go to the
smaller language code; null ids, long texts and repeated rows are no special
case; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, pick, place, prepare, share_of
from .textkernel import _BASE, Words, chunks, mix64, utf8

PER_LANG = 2000
LONGEST = 5
SHARP = 20.0
UNDETERMINED = "und"
#: What is added to each count.
SMOOTH = 0.1

#: Bytes that end a word: all ASCII but letters.  Bytes of other characters belong to words.
GAP = np.ones(256, dtype=bool)
GAP[0x61:0x7B] = GAP[0x41:0x5B] = False
GAP[0x80:] = False
OPEN, CLOSE = ord("<"), ord(">")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True where crc32 of the id as text leaves ``part`` (a null id: never)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def lower_words(texts: pa.Array) -> Words:
    raw, offsets = utf8(pc.utf8_lower(texts))
    return Words(raw, offsets, GAP[raw])


def marked(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, word of each) of words between ``<`` and ``>``, which no word holds."""
    if not words:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    points = np.frombuffer((b"<" + b"><".join(words) + b">").decode(errors="replace").encode("utf-32-le"), dtype=np.uint32)
    return points, np.cumsum(points == OPEN) - 1


def gram_hashes(points: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of each n-gram of ``size`` characters that lies inside a marked word."""
    n = len(points) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    codes = mix64((points.astype(np.uint64) + np.uint64(1)) * _BASE)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        out = out * _BASE + codes[j : j + n]
    inside = owner[:n] == owner[size - 1 :]
    return owner[:n][inside], mix64(out[inside])


@dataclass
class Scores:
    """Log frequencies of hashed keys by language: ``base`` for all, ``gain`` on top where a language has the key."""

    keys: np.ndarray  # sorted
    starts: np.ndarray  # of each key's entries
    langs: np.ndarray
    gain: np.ndarray
    base: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, langs: np.ndarray, mass: np.ndarray, number: int) -> Scores:
        """From one (hash, language, mass) entry for each key of a language."""
        order = np.lexsort((langs, hashes))
        hashes, langs, mass = hashes[order], langs[order], mass[order]
        keys, starts = np.unique(hashes, return_index=True)
        total = np.bincount(langs, mass, minlength=number) + SMOOTH * max(1, len(keys))
        return cls(keys, np.append(starts, len(hashes)), langs.astype(np.int16), np.log1p(mass / SMOOTH).astype(np.float32), np.log(SMOOTH / total).astype(np.float32))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether known) of each hash."""
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return place, self.keys[place] == hashes

    def sums(self, row: np.ndarray, place: np.ndarray, rows: int) -> np.ndarray:
        """(rows x languages) sums of the scores of the keys at ``place``, each counted for its ``row``."""
        number = len(self.base)
        sizes = self.starts[place + 1] - self.starts[place]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[place] - (ends - sizes), sizes)
        out = np.bincount(np.repeat(row, sizes) * number + self.langs[at], self.gain[at], minlength=rows * number).reshape(rows, number)
        return out + np.bincount(row, minlength=rows)[:, None] * self.base


@dataclass
class Model:
    langs: list[str]
    words: Scores
    grams: list[Scores]  # of length 1 and so on

    def back_off(self, words: list[bytes]) -> np.ndarray:
        """(words x languages): mean score of the known n-grams of the greatest length that has any; zeros if none is known."""
        out = np.zeros((len(words), len(self.langs)))
        points, owner = marked(words)
        open_words = np.ones(len(words), dtype=bool)
        for size in range(LONGEST, 0, -1):
            table = self.grams[size - 1]
            word, hashes = gram_hashes(points, owner, size)
            left = open_words[word]
            word, hashes = word[left], hashes[left]
            place, known = table.find(hashes)
            word, place = word[known], place[known]
            found = np.bincount(word, minlength=len(words))
            some = found > 0
            out[some] = table.sums(word, place, len(words))[some] / found[some, None]
            open_words &= ~some
        return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Model:
    """A model from the bounded sample of ``docs`` (texts and languages that are not null)."""
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).where("text is not null and lang is not null")
    counts = [(r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()]  # a row a language
    langs = sorted(lang for lang, _ in counts)
    if not langs:
        return build([], pa.table({"k": pa.array([], pa.int8()), "hash": pa.array([], pa.int64()), "at": pa.array([], pa.int32()), "mass": pa.array([], pa.float64())}))
    rates = docs.sparkSession.createDataFrame([(lang, langs.index(lang), min(1.0, per_lang / n)) for lang, n in counts], "lang string, at int, rate double")
    sample = rows.join(F.broadcast(rates), "lang").where(share_of("doc_id") < F.col("rate")).select("at", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in chunks(batch, "text", 1 << 20):
                words = lower_words(some.column(1))
                if not len(words):
                    continue
                lang = np.repeat(some.column(0).to_numpy(), words.counts())
                order = np.lexsort((words.hashes(), lang))
                hashes, lang = words.hashes()[order], lang[order]
                first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (lang[1:] != lang[:-1])]))
                data, at = words.raw.tobytes(), order[first]
                texts = [data[s:e] for s, e in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(lang[first], pa.int32()), pa.array(texts, pa.binary()), pa.array(np.diff(np.append(first, len(lang))), pa.int64())], names=["at", "word", "n"])

    counted = cut(sample.mapInArrow(lean(count), "at int, word binary, n long").groupBy("at", "word").agg(F.sum("n").alias("n")))
    parts = counted.mapInArrow(lean(_parts), "k byte, hash long, at int, mass double").groupBy("k", "hash", "at").agg(F.sum("mass").alias("mass"))
    return build(langs, parts.toArrow())  # what the sample's documents hold at most


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, hash, language, mass) of counted words: the word itself as k 0, then its n-grams, weighted by 1 + log of its count."""
    for batch in batches:
        lang, n = batch.column(0).to_numpy().astype(np.int64), batch.column(2).to_numpy().astype(float)
        words = batch.column(1).to_pylist()
        points, owner = marked(words)
        whole = Words(*utf8(batch.column(1)), np.zeros(sum(map(len, words)), dtype=bool)).hashes()
        for k in range(LONGEST + 1):
            word, hashes = gram_hashes(points, owner, k) if k else (np.arange(len(words)), whole)
            mass = (1.0 + np.log(n[word])) if k else n
            order = np.lexsort((lang[word], hashes))
            hashes, at, mass = hashes[order], lang[word][order], mass[order]
            first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (at[1:] != at[:-1])])) if len(hashes) else np.empty(0, np.int64)
            sums = np.add.reduceat(mass, first) if len(first) else mass
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), k), pa.int8()), pa.array(hashes[first].view(np.int64)), pa.array(at[first], pa.int32()), pa.array(sums, pa.float64())], names=["k", "hash", "at", "mass"])


def build(langs: list[str], parts: pa.Table) -> Model:
    """The model of ``_parts``' rows, summed over all batches."""
    k, hashes = parts.column("k").to_numpy(), parts.column("hash").to_numpy().view(np.uint64)
    at, mass = parts.column("at").to_numpy(), parts.column("mass").to_numpy()
    tables = [Scores.of(hashes[k == size], at[k == size], mass[k == size], len(langs)) for size in range(LONGEST + 1)]
    return Model(langs, tables[0], tables[1:])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row.  The model's size is bounded by training."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in chunks(batch, "text", 1 << 20):
                best, score = judge(shared.value, some.column(1))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def judge(model: Model, texts: pa.Array) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if not model.langs:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    words = lower_words(texts)
    sums, counts = np.zeros((len(texts), len(model.langs))), words.counts()
    if len(words):
        hashes, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        place, known = model.words.find(hashes)
        scores = np.empty((len(hashes), len(model.langs)))
        scores[known] = model.words.sums(np.arange(int(known.sum())), place[known], int(known.sum()))
        data, unseen = words.raw.tobytes(), first[~known]
        scores[~known] = model.back_off([data[s:e] for s, e in zip(words.start[unseen].tolist(), words.end[unseen].tolist(), strict=True)])
        some = np.flatnonzero(counts)
        sums[some] = np.add.reduceat(scores[back], words.first[some], axis=0)
    calm = sums / np.maximum(1.0, counts / SHARP)[:, None]
    weight = np.exp(calm - calm.max(axis=1, keepdims=True))
    best = sums.argmax(axis=1)
    score = (weight / weight.sum(axis=1, keepdims=True))[np.arange(len(best)), best]
    return [model.langs[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters, score, 0.0).tolist()


def keep(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a language with a score of ``least`` or more."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = place(names, text_col)
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in chunks(batch, f"c{at}", 1 << 20):
                best, score = judge(shared.value, some.column(at))
                yield some.filter(pa.array([b != UNDETERMINED and s >= least for b, s in zip(best, score, strict=True)], pa.bool_()))

    return safe.mapInArrow(lean(run), safe.schema).toDF(*names)
