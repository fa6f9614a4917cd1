"""The pipeline's near-duplicate stage against brute force over sets of shingles."""

from __future__ import annotations

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from oracle import DATA

import corpus_pipeline
from tidemark.llm import simhash


def shingles(text: str | None) -> frozenset:
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def brute_kept(texts: dict[int, str]) -> set[int]:
    """The smallest id of each component of pairs with a similarity of 0.8 or more."""
    ids, label = sorted(texts), {i: i for i in texts}
    sets = {i: shingles(texts[i]) for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or 0.8 * max(len(x), len(y)) <= min(len(x), len(y)) and len(x & y) / len(x | y) >= 0.8:
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return {root(i) for i in ids}


def varied(rng: random.Random, words: list[str], share: float) -> list[str]:
    """The words with enough of their last ones new for a similarity of about ``share``."""
    n = len(words) - 4
    fresh = round(n * (1 - share) / (1 + share))
    return words[: len(words) - fresh] + [f"z{rng.randrange(10**9)}" for _ in range(fresh)]


def kept_of(spark, texts: dict[int, str]) -> set[int]:
    df = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    return {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}


def test_different_documents_stay(spark):
    """Pairs below 0.8, also many around one text in one bucket, are not merged."""
    rng = random.Random(1)
    texts = {}
    for g, share in enumerate([0.55, 0.65, 0.7, 0.75, 0.78, 0.95] * 5):
        base = [f"w{rng.randrange(10**9)}" for _ in range(200)]
        texts[10 * g], texts[10 * g + 1] = " ".join(base), " ".join(varied(rng, base, share))
    base = [f"w{rng.randrange(10**9)}" for _ in range(200)]
    for i in range(30):
        texts[1000 + i] = " ".join(varied(rng, base, 0.88))
    for i in range(0, 30, 3):
        texts[1000 + i] = " ".join(varied(rng, texts[1000 + i + 1].split(), 0.95))
    assert kept_of(spark, texts) == brute_kept(texts)


def test_stage_against_brute_force(spark):
    t = pq.read_table(str(DATA / "sf0.001/documents.parquet"))
    texts = dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    df = spark.read.parquet(str(DATA / "sf0.001/documents.parquet"))
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == brute_kept(texts)


def test_refused_links_stand_for_no_others(spark, monkeypatch):
    """A large bucket whose forest joins over refused links still finds each similar pair."""
    monkeypatch.setattr(corpus_pipeline, "RADIUS", 60)
    rng = random.Random(2)
    hub = [f"w{rng.randrange(10**9)}" for _ in range(200)]
    texts = {}
    for g in range(12):
        one = varied(rng, hub, 0.6)
        texts[2 * g], texts[2 * g + 1] = " ".join(one), " ".join(varied(rng, one, 0.93))
    assert kept_of(spark, texts) == brute_kept(texts) == set(range(0, 24, 2))
    rows = spark.createDataFrame([(None, "a b"), (1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    found = {(r["doc_id"], r["component_id"]) for r in simhash.similar(rows, 5, 2, 36, 0.999, 0.8).collect()}
    assert found == {(None, None), (1, 1), (2, 2), (3, 2)}


@pytest.mark.parametrize("large", [2_000_000, 400])
def test_large_groups_in_parts(spark, monkeypatch, large):
    """A chain of near copies far longer than a part, half of it with links of 0.7 only."""
    monkeypatch.setattr(simhash, "LARGE", large)
    monkeypatch.setattr(simhash, "LOT", 7)
    rng = random.Random(3)
    texts, words = {}, [f"w{rng.randrange(10**9)}" for _ in range(120)]
    for i in range(60):
        words = varied(rng, words, 0.9 if i % 4 else 0.7)
        rng.shuffle(words) if i % 20 == 0 else None
        texts[i] = " ".join(words)
    assert kept_of(spark, texts) == brute_kept(texts)


def test_sets_joined_as_by_brute_force():
    rng = np.random.default_rng(5)
    pool = [rng.choice(60, rng.integers(1, 30), replace=False) for _ in range(12)]
    sets = [np.unique(np.concatenate([p[rng.random(len(p)) > 0.08], rng.integers(60, 70, rng.integers(0, 3))])) for p in pool for _ in range(9)]
    counts = np.array([len(x) for x in sets])
    root = simhash.joined(np.concatenate(sets).astype(np.uint64), counts, 0.8)
    label = list(range(len(sets)))
    for _ in range(len(sets)):
        for a in range(len(sets)):
            for b in range(a):
                x, y = set(sets[a].tolist()), set(sets[b].tolist())
                if x | y and len(x & y) / len(x | y) >= 0.8:
                    label[a] = label[b] = min(label[a], label[b])
    same = lambda v: {(i, j) for i in range(len(v)) for j in range(i) if v[i] == v[j]}
    assert same(root.tolist()) == same(label) and len(set(label)) < len(sets)


def test_odd_ids_and_equal_rows(spark):
    """Null ids, an id with two texts, equal rows: one row of each group of copies stays."""
    rows = [(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, "x y z"), (None, "x y z"), (7, "p q"), (7, "r s"), (9, None), (8, "")]
    df = spark.createDataFrame([(i, t, "en", "web", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    assert sorted(got, key=str) == sorted([(5, "a b c"), (None, "x y z"), (7, "p q"), (7, "r s"), (8, "")], key=str)
    assert corpus_pipeline.near_duplicates(spark, df.limit(0), "").count() == 0


@pytest.mark.parametrize("size", [12, 60, 400])
@pytest.mark.parametrize("similarity", [0.8, 0.825, 0.85])
def test_recall_at_the_threshold(size, similarity):
    """Pairs of sets just at or above the threshold meet and are within the radius; keys do not depend on how many sets there are."""
    rng = np.random.default_rng(size)
    n = 2000
    least = round(size * similarity) + (round(size * similarity) < similarity * size)
    common = rng.integers(0, 2**64, (n, least), dtype=np.uint64)
    extra = rng.integers(0, 2**64, (n, size - least), dtype=np.uint64)
    half = (size - least) // 2
    sides = [np.concatenate([common, extra[:, :half]], axis=1), np.concatenate([common, extra[:, half:]], axis=1)]
    prints, keys = [], []
    for x in sides:
        hashes, counts = x.ravel(), np.full(n, x.shape[1])
        prints.append(np.stack([simhash.majority(hashes if k == 0 else simhash.mix64(hashes + np.uint64(0x9E3779B97F4A7C15)), counts) for k in range(2)], axis=1))
        keys.append(simhash.least_hashes(hashes, counts, simhash.least_tables(0.8, corpus_pipeline.RECALL)))
    near = simhash.within(prints[0] ^ prints[1], corpus_pipeline.RADIUS)
    met = (keys[0] == keys[1]).any(axis=1)
    print(size, similarity, near.mean(), met.mean())
    assert (near & met).mean() >= 0.995
    assert (simhash.least_hashes(sides[0][:3].ravel(), np.full(3, sides[0].shape[1]), 23) == simhash.least_hashes(sides[0].ravel(), np.full(n, sides[0].shape[1]), 23)[:3]).all()
