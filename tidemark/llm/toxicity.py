"""Toxicity scores of texts restored through a noisy channel.

Obfuscated stretches - digits and symbols for letters (``1d10t``), letters
spaced or dotted apart (``i d i o t``), letters repeated (``idiooot``) - are read
as the output of a channel: each character comes from one of a few letters, or
from nothing, and a run of one letter from one or two of it.  Viterbi decoding
finds the likeliest letters under a character trigram model, whose counts
cover all documents.  The restored words take the stretch's place, and a
logistic regression scores the text by how often features occur - whole words
and word beginnings of 4 to 8 bytes that differ from chance in their share of
toxic documents - and by whether any feature of the *lexicon* does: those that
are toxic in nearly every labelled document.

Labels are learnt from a bounded sample (about ``labelled`` rows, chosen by the
ids' hashes), which bounds the model.

Inputs: null and empty texts score as texts without any feature; labels that
are null or neither 0 nor 1 are left out; if one class has no labels, all
scores are that of the other; several labels of one document count each;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, pick, share_of
from .textkernel import _BASE, _BYTE_CODE, _POWERS, Words, chunks, mix64, utf8

LABELLED = 20_000
#: A feature is kept if Wilson's interval of this many standard errors for its share of toxic documents leaves out the share of all.
KEPT_Z = 3.3
PREFIXES = (4, 5, 6, 7, 8)
#: The lexicon: features whose share of toxic documents is this at least (lower end of Wilson's 95 % interval), and the size of its input.
SURE, SURE_INPUT = 0.9, 4.0

GAP = np.ones(256, dtype=bool)
GAP[0x61:0x7B] = False
GAP[0x80:] = False

#: What a character may have been (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "abcdefghijklmnopqrstuvwxyz"}
DROPPED = " .-_*'~^"
#: Log probabilities of the channel.
COST_LEET, COST_DROP, COST_REPEAT = -0.7, -0.1, -0.5

LETTER = np.zeros(256, dtype=bool)
LETTER[0x61:0x7B] = True
LETTER[0x80:] = True
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in LEET]] = True
BETWEEN = np.zeros(256, dtype=bool)
BETWEEN[[ord(c) for c in DROPPED]] = True

_SPACED = re.compile(r"(?<![^\W_])[a-z](?:[ .\-_*'~^][a-z](?![^\W_])){3,}")
_LEETED = re.compile(r"(?<!\S)\S*(?:[^\W\d_][0-9@$!|+(*]+[^\W\d_]|(?<!\S)[0-9@$!|+(*]+[^\W\d_]{2})\S*")
_REPEATED = re.compile(r"([a-z])\1\1+")
_LETTERS = re.compile(r"[^\W\d_]*")
#: What the channel may have changed: a repeated character, or anything but a letter.
_UNCLEAR = re.compile(r"([^\W\d_])\1+|[\W\d_]")

SYMBOLS = 28  # end of word, a to z, any other letter


def symbol_of(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 27 if letter else 0


class CharModel:
    """Log probabilities of letter trigrams; 0 stands for a word's border."""

    def __init__(self, counts: np.ndarray) -> None:
        cube = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        pairs, ones = cube.sum(axis=0), cube.sum(axis=(0, 1))
        single = (ones + 1) / (ones.sum() + SYMBOLS)
        double = (pairs + 20 * single) / (pairs.sum(axis=1, keepdims=True) + 20)
        self.log = np.log((cube + 20 * double) / (cube.sum(axis=2, keepdims=True) + 20)).tolist()

    def decode(self, noisy: str) -> str:
        """The likeliest letters behind the noisy characters.

        Two plain letters in a row leave the trigram model in one state, so
        what stands between two such pairs is decoded for itself: the result is
        that of one pass, and the work grows with the unclear characters.
        """
        plain = _UNCLEAR.sub("", noisy)
        if plain and not plain.isalpha():  # numbers that are neither letters nor digits
            return self._path(noisy, (0, 0), True)
        spots = [m.span() for m in _UNCLEAR.finditer(noisy)]
        out, at, i = [], 0, 0
        while i < len(spots):
            start, end = spots[i]
            while i + 1 < len(spots) and spots[i + 1][0] - end < 2:
                i += 1
                end = spots[i][1]
            i += 1
            stop = min(len(noisy), end + 2)
            before = [0, 0, *map(symbol_of, noisy[max(0, start - 2) : start])][-2:]
            out += [noisy[at:start], self._path(noisy[start:stop], (before[0], before[1]), stop < end + 2)]
            at = stop
        return "".join([*out, noisy[at:]])

    def _path(self, noisy: str, state: tuple[int, int], last: bool) -> str:
        """Viterbi from a known state; ``last``: a word's border follows.  A step keeps a link to the one before."""
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {state: (0.0, None)}
        i = 0
        while i < len(noisy):
            c, n = noisy[i], 1
            while i + n < len(noisy) and noisy[i + n] == c:
                n += 1
            options: list[tuple[str, float]] = []
            if c.isalpha():
                options = [(c, 0.0 if n == 1 else COST_REPEAT)] + ([(c + c, 0.0 if n == 2 else COST_REPEAT)] if n > 1 else [])
            else:
                for letter in LEET.get(c, ""):
                    options += [(letter * k, COST_LEET * k) for k in ((1, 2) if n > 1 else (1,))]
                if c in DROPPED or not options:
                    options.append(("", COST_DROP if c in DROPPED else 2 * COST_LEET))
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in best.items():
                for letters, cost in options:
                    x, y, s = a, b, score + cost
                    for letter in letters:
                        z = symbol_of(letter)
                        s += self.log[x][y][z]
                        x, y = y, z
                    if (x, y) not in after or s > after[x, y][0]:
                        after[x, y] = s, (path, letters)
            best, i = after, i + n
        path = max(((s + (self.log[a][b][0] if last else 0.0), path) for (a, b), (s, path) in best.items()), key=lambda x: x[0])[1]
        letters = []
        while path:
            path, one = path
            letters.append(one)
        return "".join(reversed(letters))


def suspects(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows whose bytes may hold an obfuscated stretch: a quick look that misses none."""
    n = len(raw)
    found = np.zeros(n, dtype=bool)
    if n > 2:
        letter = LETTER[raw]
        found[:-1] = SYMBOL[raw[:-1]] & letter[1:]
        found[2:] |= (raw[2:] == raw[1:-1]) & (raw[2:] == raw[:-2]) & letter[2:]
        between = np.zeros(n, dtype=bool)
        between[1:-1] = BETWEEN[raw[1:-1]] & letter[:-2] & letter[2:]
        found[2:] |= between[2:] & between[:-2]
    total = np.concatenate([[0], np.cumsum(found)])
    return np.flatnonzero(np.diff(total[offsets]) > 0)


def _spell(noisy: str, model: CharModel, cache: dict[str, str]) -> str:
    if len(noisy) > 64:
        return model.decode(noisy)
    found = cache.get(noisy)
    if found is None:
        found = cache[noisy] = model.decode(noisy)
    return found


def restore(text: str, model: CharModel, cache: dict[str, str]) -> str:
    """The lower-case text with its obfuscated stretches decoded; the work grows with the text's length."""
    swap = lambda match: f" {_spell(match.group(), model, cache)} "
    text = _LEETED.sub(swap, _SPACED.sub(swap, text))
    out, at = [], 0
    for match in _REPEATED.finditer(text):
        if match.start() < at:
            continue  # in the word before
        start = match.start()
        while start > at and text[start - 1].isalpha():
            start -= 1
        end = _LETTERS.match(text, match.end()).end()
        out += [text[at:start], " ", _spell(text[start:end], model, cache), " "]
        at = end
    return "".join([*out, text[at:]])


def restored(texts: pa.Array, model: CharModel, cache: dict[str, str]) -> pa.Array:
    lower = pc.fill_null(pc.utf8_lower(texts), "")
    rows = suspects(*utf8(lower))
    if len(cache) > 200_000:
        cache.clear()
    if not len(rows):
        return lower
    some = pa.array([restore(t, model, cache) for t in lower.take(pa.array(rows)).to_pylist()], lower.type)
    mask = np.zeros(len(lower), dtype=bool)
    mask[rows] = True
    return pc.replace_with_mask(lower, pa.array(mask), some)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash) of each word and each beginning shorter than its word."""
    raw, offsets = utf8(texts)
    words = Words(raw, offsets, GAP[raw])
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    up, down = _POWERS.get(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[raw] * up[: len(raw)], out=total[1:])
    rows, length = words.row_of(), words.end - words.start
    out_rows, out = [rows], [mix64((total[words.end] - total[words.start]) * down[words.start])]
    for k in PREFIXES:
        long = np.flatnonzero(length > k)
        start = words.start[long]
        out_rows.append(rows[long])
        out.append(mix64((total[start + k] - total[start]) * down[start] + np.uint64(k * int(_BASE) & (1 << 64) - 1)))
    return np.concatenate(out_rows), np.concatenate(out)


def char_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Letter trigrams of all documents: 28^3 numbers at most come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(256, dtype=np.int64)
        table[0x61:0x7B] = np.arange(1, 27)
        table[0x80:] = 27
        counts = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for some in chunks(batch, "text", 1 << 20):
                raw, _ = utf8(pc.fill_null(pc.utf8_lower(some.column(0)), ""))
                code = table[raw[(raw & 0xC0) != 0x80]].astype(np.int32)
                code = np.concatenate([[0, 0], code, [0]]).astype(np.int32)
                # a border forgets what stood before it
                before = np.where(code[1:-1] == 0, 0, code[:-2])
                at = (before * SYMBOLS + code[1:-1]) * SYMBOLS + code[2:]
                counts += np.bincount(at, minlength=SYMBOLS**3)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["code", "n"])

    rows = pick(docs, text=text_col).mapInArrow(lean(run), "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SYMBOLS**3, dtype=np.int64)
    for r in rows:
        out[r["code"]] = r["n"]
    return out


@dataclass
class Model:
    chars: CharModel
    hashes: np.ndarray  # sorted
    sure: np.ndarray  # which are in the lexicon
    weights: np.ndarray  # the last is the lexicon's
    bias: float

    def inputs(self, texts: pa.Array, cache: dict[str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, input) of the selected features, log(1 + count), and of the lexicon."""
        rows, found = features(restored(texts, self.chars, cache))
        if not len(self.hashes) or not len(found):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        hit = self.hashes[at] == found
        pair, n = np.unique(rows[hit] * len(self.hashes) + at[hit], return_counts=True)
        row, at = np.divmod(pair, len(self.hashes))
        marked = np.unique(row[self.sure[at]])
        rows, at, x = np.append(row, marked), np.append(at, np.full(len(marked), len(self.hashes))), np.append(np.log1p(n), np.full(len(marked), SURE_INPUT))
        order = np.argsort(rows, kind="stable")
        return rows[order], at[order], x[order]

    def score(self, texts: pa.Array, cache: dict[str, str]) -> np.ndarray:
        rows, at, x = self.inputs(texts, cache)
        return 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(rows, self.weights[at] * x, minlength=len(texts)), -500, 500)))


def _fit(rows: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, width: int, steps: int = 400, ridge: float = 2e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by Nesterov's accelerated gradient; the weights' penalty is a share of the mean loss."""
    n = len(y)
    w = v = np.zeros(width + 1)
    rate = 4.0 / (np.sum(x * x) / n + 1)  # the loss curves by a quarter of the mean squared length at most
    grown = 1.0
    for _ in range(steps):
        z = v[width] + np.bincount(rows, v[at] * x, minlength=n)
        error = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
        slope = np.append(np.bincount(at, error[rows] * x, minlength=width), error.sum()) / n
        slope[:width] += ridge * v[:width]
        new = v - rate * slope
        following = (1 + math.sqrt(1 + 4 * grown * grown)) / 2
        v = new + (grown - 1) / following * (new - w)
        w, grown = new, following
    return w[:width], float(w[width])


def wilson(hits: int, n: int, z: float = 1.96) -> float:
    """The lower end of Wilson's interval for a share."""
    p = hits / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", corpus: DataFrame | None = None, labelled: int = LABELLED) -> Model:
    """A model from the labels of ``docs``; ``corpus`` (default: ``docs``) is what the character model counts."""
    spark = docs.sparkSession
    chars = CharModel(char_counts(docs if corpus is None else corpus, text_col))
    known = pick(labels, doc_id=id_col, label=label_col).where("doc_id is not null and label in (0, 1)")
    rate = labelled / max(1, known.count())
    chosen = known.where(share_of("doc_id") < rate)  # about ``labelled`` rows
    sample = pick(docs, doc_id=id_col, text=text_col).where("text is not null").join(F.broadcast(chosen), "doc_id").select("label", "text")
    char_model = spark.sparkContext.broadcast(chars)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, str] = {}
        for batch in batches:
            for some in chunks(batch, "text", 1 << 20):
                label = some.column(0).to_numpy()
                rows, found = features(restored(some.column(1), char_model.value, cache))
                order = np.lexsort((rows, found))
                rows, found = rows[order], found[order]
                new = np.ones(len(rows), dtype=bool)
                new[1:] = (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])
                rows, found = rows[new], found[new]
                values, first = np.unique(found, return_index=True)
                ones = np.add.reduceat(label[rows], first) if len(first) else np.empty(0, np.int64)
                alls = np.diff(np.append(first, len(found)))
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(ones.astype(np.int64)), pa.array(alls.astype(np.int64))], names=["feature", "ones", "alls"])

    totals = {int(r["label"]): r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    if share in (0.0, 1.0):
        return Model(chars, np.empty(0, np.uint64), np.empty(0, bool), np.empty(0), 30.0 if share else -30.0)
    counted = sample.select(F.col("label").cast("long").alias("label"), "text").mapInArrow(lean(count), "feature long, ones long, alls long").groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("alls").alias("alls"))
    n, p, z2 = F.col("alls"), F.col("ones") / F.col("alls"), KEPT_Z**2
    apart = F.abs(p + z2 / (2 * n) - share * (1 + z2 / n)) > KEPT_Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    top = counted.where(apart).select("feature", "ones", "alls").collect()  # features of about ``labelled`` documents at most
    found = np.array([r["feature"] for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(found)
    hashes, sure = found[order], np.array([wilson(r["ones"], r["alls"]) >= SURE for r in top], dtype=bool)[order]
    draft = Model(chars, hashes, sure, np.zeros(len(hashes) + 1), 0.0)
    drafted = spark.sparkContext.broadcast(draft)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, str] = {}
        for batch in batches:
            for some in chunks(batch, "text", 1 << 20):
                rows, at, x = drafted.value.inputs(some.column(1), cache)
                starts = np.searchsorted(rows, np.arange(some.num_rows + 1))
                lists = lambda v, kind: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(v, kind))
                yield pa.RecordBatch.from_arrays([some.column(0), lists(at, pa.int32()), lists(x, pa.float32())], names=["label", "at", "x"])

    table = sample.select(F.col("label").cast("long").alias("label"), "text").mapInArrow(lean(vectors), "label long, at array<int>, x array<float>").toArrow().combine_chunks()  # labelled rows x features at most
    at, x = table.column("at").combine_chunks(), table.column("x").combine_chunks()
    lengths = pc.list_value_length(at).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    weights, bias = _fit(rows, at.flatten().to_numpy(), x.flatten().to_numpy().astype(float), table.column("label").to_numpy().astype(float), len(hashes) + 1)
    return Model(chars, hashes, sure, weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, str] = {}
        for batch in batches:
            for some in chunks(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(shared.value.score(some.column(1), cache))], names=["doc_id", "score"])

    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
