"""Each operator against a brute-force version on the small driver table, and on odd and empty tables."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from fixtures_llm import documents
from oracle import DATA, connection, differences

import corpus_pipeline
from tidemark.llm import ann, langid, media, mixing, packing, queries, sharding, simhash, substring, toxicity, urlfilter
from tidemark.llm.common import pick

SF = str(DATA / "sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


@pytest.fixture(scope="module")
def con():
    return connection("sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, con, name):
    assert differences(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], con) == []


#: What the queries' contracts ask for; more columns may follow.
CONTRACTS = {
    "op1_url_filter": "page_id:bigint host:string path:string rule:string verdict:string",
    "op2_language_id": "doc_id:bigint held_out:boolean lang_pred:string score:double",
    "op3_media": "doc_id:bigint n_bytes:bigint payload_bytes:bigint payload_sha256:string tail_crc32:bigint media_bytes:bigint media_sha256:string feature:string",
    "op4_substring_dedup": "doc_id:bigint n_words:bigint n_removed:bigint kept_sha256:string",
    "op5_mixing": "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint",
    "op6_sharding": "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
    "op7_simhash": "doc_id:bigint fingerprint:string component_id:bigint",
    "op8_toxicity": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op9_neighbours": "query_id:bigint rank:int vec_id:bigint score:double",
    "op10_packing": "doc_id:bigint start:bigint length:bigint ids_crc32:bigint doc_tokens:bigint sequence_id:bigint offset:bigint",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_contract_columns(spark, name):
    have = dict(queries.QUERIES[name](spark, SF).dtypes)
    assert {c: have.get(c) for c in (x.split(":")[0] for x in CONTRACTS[name].split())} == dict(x.split(":") for x in CONTRACTS[name].split())


# 1 URL filters


def test_url_parts_and_odd_rules(spark):
    rules = urlfilter.rules_table(spark, [("net", "/", "block"), ("Example.NET", "/en/", "allow"), ("example.net", "/en/a", "block"), ("x.example.net", None, "allow"), (None, "/", "block"), ("", "/", "block"), ("net", "/", "allow")])
    urls = ["http://a.example.net/en/b?x#y", "http://example.net/en/ab", "HTTP://EXAMPLE.NET/", "http://y.x.example.net", "http://net?/en/", "http://notexample.netx/", "no scheme", None, "", "ftp://a.NET/é\U0010ffff#", "://net/", "http://example.net/fr/", "http://x.example.net/en/abc"]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(df, rules).collect()}
    assert got[0] == ("a.example.net", "/en/b", "example.net/en/", "allow")
    assert got[1] == ("example.net", "/en/ab", "example.net/en/a", "block")
    assert got[2] == ("example.net", "/", "net/", "block")
    assert got[3] == ("y.x.example.net", "", "x.example.net", "allow")
    assert got[4] == ("net", "", None, "allow")
    assert got[5] == ("notexample.netx", "/", None, "allow")
    assert got[6] == got[7] == got[8] == ("", "", None, "allow")
    assert got[9] == ("a.net", "/é\U0010ffff", "net/", "block")
    assert got[10] == ("net", "/", "net/", "block")
    assert got[11][2:] == ("net/", "block")
    assert got[12][2:] == ("example.net/en/a", "block")
    assert len(got) == len(urls) and urlfilter.judge(df.limit(0), rules).count() == 0
    assert urlfilter.judge(df, rules.limit(0)).where("verdict <> 'allow' or rule is not null").count() == 0


# 2 language ID


def test_language_accuracy(spark):
    rows = queries.op2_language_id(spark, str(DATA / "sf0.01")).join(spark.read.parquet(str(DATA / "sf0.01/documents.parquet")).select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 300
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"] % 10**9 for r in rows} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}


def test_language_odd_rows(spark):
    docs = documents(spark)
    model = langid.train(docs)
    rows = langid.predict(docs, model).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["lang_pred"] == by[1]["lang_pred"] == by[2]["lang_pred"] == by[16]["lang_pred"] == "und"
    assert by[15]["lang_pred"] in ("en", "fr") and by[5]["lang_pred"] in ("en", "fr")
    nothing = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def counted(rows):
    """Parts of (language, word, n) rows, summed as training does."""
    import pyarrow as pa

    batch = pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].encode() for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["at", "word", "n"])
    return pa.Table.from_batches(langid._parts(iter([batch]))).group_by(["k", "hash", "at"]).aggregate([("mass", "sum")]).rename_columns(["k", "hash", "at", "mass"])


def test_language_backs_off():
    import pyarrow as pa

    model = langid.build(["en", "fr"], counted([(0, "the", 50), (0, "thing", 10), (1, "le", 50), (1, "lequel", 10)]))
    best, score = langid.judge(model, pa.array(["the", "things", "lequels", "123", None, "ЖЖ"]))
    assert best[:5] == ["en", "en", "fr", "und", "und"] and score[3] == 0


def test_language_scores_against_brute_force(texts):
    """Word-first back-off in plain Python, on words of the driver's texts, half of them unseen."""
    import math

    import pyarrow as pa

    split = {i: re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t.lower()) for i, t in texts.items()}
    seen = [Counter(), Counter(), Counter()]
    for i, w in split.items():
        if i % 2:
            seen[i % 3].update(w[:300])
    rows = [(k, w, n) for k, c in enumerate(seen) for w, n in c.items()]
    model = langid.build(["a", "b", "c"], counted(rows))
    grams = [[Counter() for _ in range(3)] for _ in range(6)]
    for k, w, n in rows:
        for size in range(1, 6):
            for j in range(len(w) + 3 - size):
                grams[size][k][f"<{w}>"[j : j + size]] += 1 + math.log(n)

    def logs(counters, keys, kind):
        return [[math.log((c[x] + 0.1) / (sum(c.values()) + 0.1 * kind)) for c in counters] for x in keys]

    kinds = [len(set().union(*seen))] + [len(set().union(*grams[size])) for size in range(1, 6)]

    def score(word):
        if any(word in c for c in seen):
            return logs(seen, [word], kinds[0])[0]
        for size in range(5, 0, -1):
            found = [g for j in range(len(word) + 3 - size) if any((g := f"<{word}>"[j : j + size]) in c for c in grams[size])]
            if found:
                return [sum(x) / len(found) for x in zip(*logs(grams[size], found, kinds[size]), strict=True)]
        return [0.0] * 3

    some = [" ".join(w[:12]) for i, w in sorted(split.items()) if not i % 2][:60]
    best, got = langid.judge(model, pa.array(some))
    for text, b, g in zip(some, best, got, strict=True):
        words = text.split()
        sums = [sum(x) for x in zip(*map(score, words), strict=True)] if words else [0.0] * 3
        top = max(range(3), key=lambda k: (sums[k], -k))
        if words:
            assert b == "abc"[top] and abs(g - 1 / sum(math.exp(x - sums[top]) for x in sums)) < 1e-4


# 3 media


def test_media_round_trip(spark):
    docs = documents(spark)
    rows = {(r["doc_id"], r["text"]): r for r in pick(docs, "doc_id", "text").collect()}
    stored = media.store(docs)
    assert stored.count() == len(docs.collect())
    for r in media.read(stored).collect():
        assert r["error"] is None and len(r["payload"]) % 192 == 0
        assert len(r["payload"]) == max(192, -(-r["n_bytes"] // 192) * 192)
    plain = {media.pad((t or "").encode()) for _, t in rows}
    assert {bytes(r["payload"]) for r in media.read(stored).collect()} == plain
    broken = spark.createDataFrame([(bytearray(b"junk"),), (None,)], "media binary")
    assert [r["error"] for r in media.read(broken).collect()] == ["no signature", "no signature"]


def test_media_query(spark, texts):
    rows = queries.op3_media(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        payload = media.pad(texts[r["doc_id"]].encode())
        assert r["n_bytes"] == len(texts[r["doc_id"]].encode()) and r["payload_bytes"] == len(payload)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert r["media_bytes"] == len(media.encode(payload)) and r["media_sha256"] == hashlib.sha256(media.encode(payload)).hexdigest()
    same = defaultdict(set)
    for r in rows:
        same[r["payload_sha256"]].add((r["feature"], r["media_sha256"]))
    assert all(len(v) == 1 for v in same.values())


def test_hash_against_a_plain_transform(texts):
    """The bits of a cosine transform written out in floating point, but for coefficients that lie at the median."""
    import math

    certain = 0
    for i, t in sorted(texts.items())[:25]:
        payload = media.pad(t.encode())
        image = np.frombuffer(payload, np.uint8).reshape(-1, 192).astype(float)
        small = image
        for axis in (0, 1):
            n = small.shape[axis]
            edges = [k * n // 32 for k in range(33)]
            small = np.stack([small.take(range(edges[k], edges[k + 1]), axis).mean(axis) if n >= 32 else small.take(edges[k], axis) for k in range(32)], axis)
        low = [[sum(small[y, x] * math.cos(math.pi / 32 * u * (y + 0.5)) * math.cos(math.pi / 32 * v * (x + 0.5)) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
        flat = np.array(low).ravel()
        middle = np.sort(flat[1:])[31]
        bits = np.unpackbits(np.frombuffer(media.cosine_hash(media.decode(media.encode(payload))), np.uint8)).astype(bool)
        sure = np.abs(flat - middle) > 1.0
        assert (bits == (flat > middle))[sure].all(), i
        certain += sure.sum()
    assert certain > 25 * 40  # an image of one row has but 8 coefficients that are not zero


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4, None])
def test_png_filters(kind):
    """Every filter of the format, and a mix of all, applied sample by sample and undone."""
    rng = np.random.default_rng(kind or 9)
    image = rng.integers(0, 256, (9, 24), dtype=np.uint8)
    lines = np.zeros((9, 25), dtype=np.uint8)
    mix = kind is None
    for y in range(9):
        kind = y % 5 if mix else kind
        lines[y, 0] = kind
        for x in range(24):
            a = int(image[y, x - 1]) if x else 0
            b = int(image[y - 1, x]) if y else 0
            c = int(image[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            lines[y, x + 1] = (int(image[y, x]) - (0, a, b, (a + b) // 2, near)[kind]) & 255
    assert (media.unfilter(lines) == image).all()


def test_png_damage():
    good = media.encode(b"x" * 384)
    for at in (0, 20, 50, len(good) - 3):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.decode(bytes(bad))
    with pytest.raises(ValueError):
        media.decode(good[:-8])


def test_hash_is_near_for_near_images():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (64, 192), dtype=np.uint8)
    b = a.copy()
    b[3, 5] ^= 1
    bits = lambda x: np.unpackbits(np.frombuffer(media.cosine_hash(x), np.uint8))
    assert (bits(a) != bits(b)).sum() <= 2
    assert (bits(a) != bits(rng.integers(0, 256, (64, 192), dtype=np.uint8))).sum() > 10


# 4 substring dedup


def brute_removed(rows: list[tuple[int | None, str | None]], window: int) -> list[tuple]:
    first: dict[tuple, int] = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize(("window", "gram"), [(13, 5), (40, 8), (3, 1)])
def test_substring_odd_rows(spark, window, gram):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in pick(docs, "doc_id", "text").collect()]
    got = [(r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"]).decode()) for r in substring.remove_repeats(docs, window, gram).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(brute_removed(rows, window), key=key)
    assert substring.remove_repeats(docs.limit(0), window, gram).count() == 0


def thue_morse(n: int, a: str, b: str) -> str:
    """Words of 2 ** n letters whose polynomial hashes modulo 2 ** 64 agree, whatever the base, once n is 10 or more."""
    x, y = a, b
    for _ in range(n):
        x, y = x + y, y + x
    return x


def removed(spark, rows, window=13, gram=5):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"]).decode()) for r in substring.remove_repeats(df, window, gram).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(brute_removed(rows, window), key=key)
    return got


def test_substring_tells_colliding_words_apart(spark):
    words = [f"v{i}" for i in range(12)]
    with_word = lambda w: " ".join([*words[:6], w, *words[6:]])
    for n in (10, 12):
        got = removed(spark, [(0, with_word("other")), (1, with_word(thue_morse(n, "a", "b"))), (2, with_word(thue_morse(n, "b", "a"))), (3, with_word(thue_morse(n, "a", "b")))])
        assert {r[0]: r[2] for r in got} == {0: 0, 1: 0, 2: 0, 3: 13}


def test_substring_hot_anchors(spark, monkeypatch):
    """Passages of very many documents, whole and as part of others, and rows that share an id."""
    import random

    monkeypatch.setattr(substring, "HOT", 3)
    rng = random.Random(6)
    fresh = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    common = fresh(40)
    rows = [(i, f"{fresh(i % 5)} {common} {fresh(3)}") for i in range(40)] + [(i, common) for i in range(40, 50)] + [(7, f"{common} {fresh(9)}"), (None, common)]
    removed(spark, rows)
    removed(spark, [(i % 6, t) for i, (_, t) in enumerate(rows)])


def test_substring_small_lots(spark, texts, monkeypatch):
    monkeypatch.setattr(substring, "LOT", 13 * 7)
    removed(spark, sorted(texts.items())[:60])


# 5 mixing


def test_mixing_targets_and_totals(spark):
    docs = documents(spark)
    rows = mixing.shares(docs).collect()
    assert len(rows) == docs.count()
    total = sum(r["size"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source_size"]].append(r)
    for found in by.values():
        target = found[0]["target"]
        assert target <= 2 * found[0]["source_size"] and abs(sum(r["taken"] for r in found) - target) <= 1
    assert abs(sum(r["target"] for r in {(r["source_size"], r["target"]): r for r in rows}.values()) - 1.5 * total) <= 0.01 * total
    assert sorted(rows, key=str) == sorted(mixing.shares(docs).collect(), key=str)
    assert mixing.shares(docs.limit(0)).count() == 0


def test_mixed_rows(spark):
    docs = documents(spark)
    taken = sum(r["taken"] for r in mixing.shares(docs).collect())
    rows = mixing.mixed(pick(docs, "doc_id", "text", "lang", "source", "n_chars")).collect()
    assert sum(len(WORD.findall(r["text"])) for r in rows) == taken
    assert mixing.mixed(pick(docs, "doc_id", "text", "source").limit(0)).count() == 0
    assert mixing.mixed(docs.drop("size")).columns == docs.drop("size").columns


def test_mixed_reruns_agree(spark):
    """Rows that share id, source and size but not the text, in any partitioning; equal rows each for itself."""
    rows = [(1, f"w{i} x y", "s", i) for i in range(12)] + [(2, "a b c", "t", 0)] * 5 + [(None, f"q{i}", "s", 0) for i in range(6)]
    runs = []
    for order, n in ((rows, 1), (rows[::-1], 3)):
        df = spark.createDataFrame(order, "doc_id long, text string, source string, __n int").repartition(n)
        runs.append(sorted((str(r["doc_id"]), r["text"], r["source"], r["__n"]) for r in mixing.mixed(df).collect()))
        shares = mixing.shares(df).collect()
        assert sum(len(t.split()) for _, t, _, _ in runs[-1]) == sum(r["taken"] for r in shares)
        assert sum(r["taken"] for r in shares if r["doc_id"] == 2) == sum(3 for i, *_ in runs[-1] if i == "2")
    assert runs[0] == runs[1]


def test_mixing_offsets_have_no_gaps(spark):
    rows = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).select("mix_offset", "words", "finish").orderBy("mix_offset").collect()
    at, last = 0, 0.0
    for r in rows:
        assert r["mix_offset"] == at and r["finish"] >= last
        at, last = at + r["words"], r["finish"]


# 6 sharding


def brute_shard(doc_id, tree) -> tuple[int, float]:
    import math

    def draw(path: str, child: str, weight: float) -> float:
        bits = int(hashlib.md5("/".join([str(doc_id), path, child]).encode()).hexdigest()[:13], 16)
        return -math.log((bits + 0.5) / (1 << 52)) / weight

    def pick(path: str, children: dict[str, float]) -> str:
        return min((draw(path, c, w) if len(children) > 1 else 0.0, c) for c, w in children.items())[1]

    region = pick("root", {g: sum(sum(s.values()) for s in ks.values()) for g, ks in tree.items()})
    rack = pick(region, {k: sum(s.values()) for k, s in tree[region].items()})
    leaves = sorted(tree[region][rack].items())
    return leaves[int(pick(f"{region}/{rack}", {str(i): w for i, (_, w) in enumerate(leaves)}))][0]


def test_sharding_query(spark, texts):
    rows = queries.op6_sharding(spark, SF).collect()
    base, grown = sharding.tree(16), sharding.tree(17)
    slots = defaultdict(list)
    for r in rows:
        t = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(t) + 1, zlib.crc32(t), "key")
        assert r["shard"] == brute_shard(r["doc_id"], base) and r["grown_shard"] == brute_shard(r["doc_id"], grown)
        assert r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(rows) == len(texts)


def test_sharding_odd_rows(spark):
    docs = documents(spark)
    rows = sharding.assign(docs).collect()
    assert len(rows) == docs.count() and {r["size"] for r in rows if r["doc_id"] == 0} == {1}
    assert sharding.assign(docs.limit(0)).count() == 0


def test_sharding_weights_confine_movement(spark):
    docs = spark.range(4000).selectExpr("cast(id as string) as key")
    a = sharding.tree(16)
    b = sharding.tree(16)
    b["g1"]["k0"][4] = 3.0
    x = {r["key"]: r["s"] for r in sharding.descend(docs, "key", a, "s").collect()}
    y = {r["key"]: r["s"] for r in sharding.descend(docs, "key", b, "s").collect()}
    moved = [(x[k], y[k]) for k in x if x[k] != y[k]]
    assert moved and all(to in (4, 5, 6, 7) for _, to in moved)
    counts = Counter(y.values())
    assert counts[4] > 2 * counts[0] * 0.8 and max(Counter(x.values()).values()) < 1.5 * min(Counter(x.values()).values())


# 7 SimHash


def brute_fingerprint(text: str | None) -> int:
    import xxhash

    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORD.findall(lower)
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints: dict[int, int], radius: int) -> dict[int, int]:
    label = {i: i for i in prints}
    ids = sorted(prints)
    changed = True
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= radius]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_simhash_query(spark, texts):
    rows = queries.op7_simhash(spark, SF).collect()
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    labels = brute_components(prints, 4)
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in rows} == {i: (prints[i], labels[i]) for i in texts}


def test_simhash_odd_rows(spark):
    docs = documents(spark)
    rows = simhash.groups(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    assert by[0] == by[1] == by[2] == 0 and by[6] == by[7] == 6 and by[12] == by[13]
    assert all(r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert simhash.groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [3, 40, 700])
def test_forest_joins_what_the_radius_joins(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**64, max(1, n // 10), dtype=np.uint64)
    prints = base[rng.integers(0, len(base), n)]
    for _ in range(3):
        prints = prints ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    left, right = simhash._forest(prints[:, None], 4)
    label = brute_components(dict(enumerate(prints.tolist())), 4)
    mine = list(range(n))

    def root(i):
        while mine[i] != i:
            i = mine[i]
        return i

    for a, b in zip(left, right, strict=True):
        mine[max(root(a), root(b))] = min(root(a), root(b))
    assert len(left) < n and [root(i) for i in range(n)] == [label[i] for i in range(n)]


def test_large_buckets_are_cut_without_loss(monkeypatch):
    """One bucket of 6,000 classes that share half of their bits: its links join what all pairs join, with far fewer comparisons."""
    rng = np.random.default_rng(9)
    prints = rng.integers(0, 2**32, 6000, dtype=np.uint64)
    for k in range(1, 3000, 2):
        prints[k] = prints[k - 1] ^ np.uint64(sum(1 << int(b) for b in rng.choice(32, k % 7, replace=False)))
    compared = []
    plain = simhash.within
    monkeypatch.setattr(simhash, "within", lambda x, radius: (compared.append(len(x)), plain(x, radius))[1])
    a, b = simhash._in_buckets(prints[:, None], np.zeros(6000, np.int64), 4)
    assert sum(compared) < 6000 * 6000 / 20
    i, j = np.triu_indices(6000, 1)
    near = np.bitwise_count(prints[i] ^ prints[j]) <= 4
    assert (np.bitwise_count(prints[a] ^ prints[b]) <= 4).all()

    def labels(links):
        mine = list(range(6000))

        def root(x):
            while mine[x] != x:
                mine[x] = mine[mine[x]]
                x = mine[x]
            return x

        for x, y in links:
            x, y = root(x), root(y)
            mine[max(x, y)] = min(x, y)
        return [root(x) for x in range(6000)]

    assert labels(zip(a.tolist(), b.tolist(), strict=True)) == labels(zip(i[near].tolist(), j[near].tolist(), strict=True))


@pytest.mark.parametrize(("lanes", "radius"), [(1, 4), (1, 0), (2, 25), (4, 50)])
def test_bit_sliced_distances(lanes, radius):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**64, (9000, lanes), dtype=np.uint64)
    for _ in range(2):
        x[:5000] &= rng.integers(0, 2**64, (5000, lanes), dtype=np.uint64)
    x[:50] = 0
    assert (simhash.within(x, radius) == (np.bitwise_count(x).sum(axis=1) <= radius)).all()


def test_exact_tables_miss_nothing():
    rng = np.random.default_rng(4)
    for classes in (10, 10**5, 10**9):
        tables = [t[0] & (1 << 64) - 1 for t in simhash.exact_tables(4, classes)]
        for _ in range(200):
            flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(not t & flips for t in tables)


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(101, 100), (103, 101), (200, 7)]
    got = {r["u"]: r["component"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in [*range(1, 41), 200]) and got[101] == got[103] == 100


# 8 toxicity


def test_toxicity_held_out(spark):
    sf = str(DATA / "sf0.1")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op8_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    hit = sum(r["predicted"] and labels[r["doc_id"]] for r in rows)
    assert hit / sum(labels[r["doc_id"]] for r in rows) > 0.85
    assert hit / sum(r["predicted"] for r in rows) > 0.85


def test_restoration():
    counts = np.zeros(28**3, dtype=np.int64)
    for word in ["idiot", "stupid", "moron", "trash", "loser", "clown"] * 50:
        code = [0, 0, *map(toxicity.symbol_of, word), 0]
        for a, b, c in zip(code, code[1:], code[2:], strict=False):
            counts[(a * 28 + b) * 28 + c] += 1
    model = toxicity.CharModel(counts)
    for noisy, plain in [("1d10t", "idiot"), ("i d i o t", "idiot"), ("stuuuupid", "stupid"), ("tr@sh", "trash"), ("m0r0n", "moron"), ("l.o.s.e.r", "loser"), ("$tup1d", "stupid"), ("id*ot", "idiot")]:
        assert toxicity.restore(f"you {noisy} there", model, {}).split() == ["you", plain, "there"], noisy
    plain = "an ordinary text, with 12 numbers; a b c and don't!!"
    assert toxicity.restore(plain, model, {}) == plain


def _char_model(seed: int = 0) -> toxicity.CharModel:
    return toxicity.CharModel(np.random.default_rng(seed).integers(0, 40, 28**3))


def test_decoding_against_all_readings():
    """The likeliest of all readings of short strings, found by trying each."""
    import itertools
    import random

    model, rng = _char_model(), random.Random(4)

    def readings(noisy: str):
        parts = []
        for c, run in itertools.groupby(noisy):
            n, options = len(list(run)), []
            if c.isalpha():
                options = [(c, 0.0 if n == 1 else toxicity.COST_REPEAT)] + ([(c * 2, 0.0 if n == 2 else toxicity.COST_REPEAT)] if n > 1 else [])
            else:
                options = [(x * k, toxicity.COST_LEET * k) for x in toxicity.LEET.get(c, "") for k in ((1, 2) if n > 1 else (1,))]
                if c in toxicity.DROPPED or not options:
                    options.append(("", toxicity.COST_DROP if c in toxicity.DROPPED else 2 * toxicity.COST_LEET))
            parts.append(options)
        for chosen in itertools.product(*parts):
            text = "".join(x for x, _ in chosen)
            code = [0, 0, *map(toxicity.symbol_of, text), 0]
            yield sum(c for _, c in chosen) + sum(model.log[a][b][c] for a, b, c in zip(code, code[1:], code[2:], strict=False)), text

    for _ in range(300):
        noisy = "".join(rng.choice("abcdeéz" * 3 + "0113.-_#²") * rng.choice((1, 1, 1, 2, 3)) for _ in range(rng.randrange(1, 9)))
        scores = {}
        for s, t in readings(noisy):
            scores[t] = max(s, scores.get(t, -1e9))
        assert scores[model.decode(noisy)] >= max(scores.values()) - 1e-9, noisy


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "acgt", "abcdefghijklmnopqrstuvwxyz0123456789+/", "a"])
def test_restoration_is_linear(alphabet):
    """A megabyte without a space, as a whole and as one stretch among words."""
    import random
    import time

    rng, model = random.Random(1), _char_model()
    text = "you 1d10t " + "".join(rng.choices(alphabet, k=1 << 20)) + " aaa"
    began = time.process_time()
    toxicity.restore(text, model, {})
    assert time.process_time() - began < 12


def test_toxicity_scores_against_plain_python(texts):
    """Features counted word by word, and the weighted sum written out."""
    import math

    import pyarrow as pa

    some = [t.lower()[:4000] for _, t in sorted(texts.items())[:40]] + ["", "ab", "abcdefghij abcdefghij abcde"]

    def found(text):
        out = Counter()
        for w in re.findall(rb"[a-z\x80-\xff]+", text.encode()):
            out[w] += 1
            for k in toxicity.PREFIXES:
                if len(w) > k:
                    out[b"-" + w[:k]] += 1  # a beginning is another feature than the same word
        return out

    def hashed(words):
        rows, h = toxicity.features(pa.array([w.decode() for w in words]))
        return dict(zip((words[r] for r in rows[: len(words)]), h[: len(words)].tolist(), strict=True))

    seen = sorted({w for t in some for w in found(t) if not w.startswith(b"-")})
    whole = hashed(seen)
    rng = np.random.default_rng(3)
    chosen = {w: h for w, h in whole.items() if rng.random() < 0.3}
    begun = {}
    for w in seen:
        for k in toxicity.PREFIXES:
            if len(w) > k and rng.random() < 0.2:
                _, h = toxicity.features(pa.array([w.decode()]))
                at = 1 + [x for x in toxicity.PREFIXES if len(w) > x].index(k)
                begun[b"-" + w[:k]] = int(h[at])
    names = {h: w for w, h in (chosen | begun).items()}
    hashes = np.array(sorted(names), dtype=np.uint64)
    weights, sure = rng.normal(size=len(hashes) + 1), rng.random(len(hashes)) < 0.05
    model = toxicity.Model(_char_model(), hashes, sure, weights, -0.3)
    plain = [t for t in some if not len(toxicity.suspects(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])))]
    assert len(plain) > 10
    got = model.score(pa.array(plain), {})
    for text, score in zip(plain, got.tolist(), strict=True):
        counts, z, marked = found(text), -0.3, False
        for h, w, is_sure in zip(hashes.tolist(), weights, sure, strict=False):
            n = counts[names[h]]
            z += w * math.log1p(n)
            marked |= bool(is_sure and n)
        z += weights[-1] * toxicity.SURE_INPUT * marked
        assert abs(score - 1 / (1 + math.exp(-z))) < 1e-9


def test_toxicity_odd_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (None, 1, 1), (6, None, 1), (7, 3, 1), (9, 0, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).count() == docs.count()
    assert {r["score"] < 0.01 for r in toxicity.score(docs, toxicity.train(docs, labels.where("toxic = 0"))).collect()} == {True}
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.train(docs.limit(0), labels.limit(0)).bias < 0


# 9 neighbours


def test_recall(spark):
    rows = queries.op9_neighbours(spark, str(DATA / "sf0.1")).collect()
    t = pq.read_table(str(DATA / "sf0.1/embeddings.parquet"))
    ids, x = t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), dtype=float)
    found = defaultdict(set)
    for r in rows:
        found[r["query_id"]].add(r["vec_id"])
    hits = wanted = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = set(ids[np.argsort(-s)[:20]].tolist())
        hits += len(best & found[q])
        wanted += len(best)
    assert hits / wanted >= 0.99


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (40, [1.0, 1.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in sorted(ann.search(df).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert dict(got) == {0: [(1, 1.0), (2, 1.0), (None, 1.0), (20, 0.0)], 20: [(None, 1.0), (0, 0.0), (1, 0.0), (2, 0.0)], 40: [(9, 6.0)]}
    assert ann.search(df.limit(0)).count() == 0


def test_neighbours_of_repeated_ids(spark):
    """Rows that share an id are candidates for each other, and each has its own ranks."""
    df = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0]), (None, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], -1 if r["vec_id"] is None else r["vec_id"], r["score"]) for r in ann.search(df).collect())
    assert got == sorted([(20, 1, -1, 2.0), (20, 2, 3, 1.0), (20, 3, 20, 0.0), (20, 1, 3, 1.0), (20, 2, 20, 0.0), (20, 3, -1, 0.0)])


def test_recall_over_many_blocks(spark, monkeypatch):
    """Every block and lot boundary crossed: the result is that of one block."""
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    whole = sorted(map(tuple, ann.search(df).collect()))
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "QUERIES", 8)
    assert sorted(map(tuple, ann.search(df).collect())) == whole


# 10 packing


def test_packing_query(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rows = queries.op10_packing(spark, SF).collect()
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    parts, filled = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and len(part) == r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        parts[r["doc_id"]].append((r["start"], r["length"]))
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, found in parts.items():
        assert [s for s, _ in sorted(found)] == list(range(0, len(ids[i]), 2048)) and sum(n for _, n in found) == len(ids[i])
    for found in filled.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(filled) <= -(-sum(map(len, ids.values())) // 2048) * 1.02 + 1


def test_packing_odd_rows(spark):
    docs = documents(spark)
    rows = packing.pack(docs, queries.tokenizer_path(), window=64, group_docs=5).collect()
    assert sum(r["start"] == 0 for r in rows) == docs.count()
    assert packing.pack(docs.limit(0), queries.tokenizer_path()).count() == 0


def test_encoder_agrees_with_tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer, encoder = Tokenizer.from_file(path), packing.Encoder(path, 1, limit=50)
    odd = ["", "a's 's x''s 12 3.4é É ß ſ", "<|endoftext|> hi", "Σας ΟΔΟΣ", "İstanbul", "x\x1cy", "½ ² ª º µ ×÷", "can't WE'LL i'd''re 'Ve", "\x85a\xa0b", "日本語", "é", "word " * 300, *[f"w{i} v{i}'s" for i in range(200)]]
    want = [struct.pack(f"<{len(x) + 1}I", *x, 1) for x in (tokenizer.encode(t, add_special_tokens=False).ids for t in odd)]
    assert encoder.encode(odd) == want


def test_encoder_looks_words_up_once():
    encoder, asked = packing.Encoder(queries.tokenizer_path(), 1, limit=8), []
    words = encoder._words
    encoder._words = lambda some: asked.append(sorted(some)) or words(some)
    first = encoder.encode(["one two one", "two three", "one"])
    assert encoder.encode(["four five"]) and encoder.encode(["one two one", "two three", "one"]) == first
    assert asked == [["one", "three", "two"], ["five", "four"]] and isinstance(encoder.known, packing.Words)
    assert encoder.encode(["six"]) and encoder.encode(["seven eight"]) and "four" not in encoder.known.older | encoder.known
    encoder._words = lambda some: 1 / 0
    with pytest.raises(ZeroDivisionError):
        encoder.encode(["nine one"])
    encoder._words = words
    assert encoder.encode(["nine one"]) == [encoder._ids(["nine one"])[0] + encoder.end]


def test_best_fit_is_tightest():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 101, 500))[::-1]
    sequence, offset = packing.best_fit(lengths, 100)
    room: dict[int, int] = {}
    for n, s, o in zip(lengths.tolist(), sequence.tolist(), offset.tolist(), strict=True):
        fits = [r for r in room.values() if r >= n]
        if s in room:
            assert room[s] == min(fits) and o == 100 - room[s]
        else:
            assert not fits and o == 0
        room[s] = room.get(s, 100) - n


# the pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.cut(stage(spark, kept, SF))
        assert tuple(kept.columns) == corpus_pipeline.COLUMNS, name
        if name == "near_duplicates":
            rows = kept.collect()
            assert len({r["text"] for r in rows}) == len(rows)
            first = {}
            for i in sorted(texts):
                first.setdefault(texts[i], i)
            assert {r["doc_id"] for r in rows} <= set(first.values())
        if name == "repeated_passages":
            shared = Counter(g for r in kept.collect() for w in [WORD.findall(r["text"])] for g in {tuple(w[i : i + 40]) for i in range(len(w) - 39)})
            assert not [g for g, n in shared.items() if n > 1]
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert sum(p["length"] for p in pieces if p["start"] == 0 or p["start"] % 2048 == 0) == sum(p["length"] for p in pieces)
    assert corpus_pipeline.run(spark, SF).count() == len(pieces)


def test_pipeline_on_odd_rows(spark):
    docs = documents(spark)
    for empty in (False, True):
        kept = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES:
            kept = corpus_pipeline.cut(stage(spark, kept, SF))
        assert (kept.count() == 0) == empty
