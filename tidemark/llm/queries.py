"""The operators' registered queries, with production parameters over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, langid, media, mixing, packing, sharding, simhash, substring, toxicity, urlfilter

#: (host, path, verdict)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rules_table(spark, URL_RULES))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"), 3, 1)
    model = langid.train(docs.where(~held))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = media.read(media.store(table(spark, sf_dir, "documents")))
    tail = F.expr("substring(payload, length(payload) - 15, 16)")
    return kept.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("hash")).alias("feature"),
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents")).select("doc_id", simhash.hexadecimal(F.col("f0")).alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"), 4, 2)
    model = toxicity.train(docs.where(~held), table(spark, sf_dir, "labels").where(~held), corpus=docs)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_language_id, op3_media, op4_substring_dedup, op5_mixing, op6_sharding, op7_simhash, op8_toxicity, op9_neighbours, op10_packing)}

OP1_SQL = r"""
WITH rules(rhost, rpath, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
fits AS (SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS n
  FROM parts p LEFT JOIN rules r ON ('.' || p.host) LIKE ('%.' || r.rhost) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1
"""

OP4_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM w WHERE len(words) >= 13),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS phrase FROM starts),
first AS (SELECT phrase, min(doc_id) AS owner FROM windows GROUP BY phrase),
hit AS (SELECT windows.doc_id, i FROM windows JOIN first USING (phrase) WHERE owner < windows.doc_id),
gone AS (SELECT doc_id, list(DISTINCT p) AS places FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM hit) GROUP BY doc_id),
kept AS (SELECT w.doc_id, words, coalesce(len(places), 0) AS n_removed,
    CASE WHEN places IS NULL THEN words ELSE list_filter(words, lambda x, p: NOT list_contains(places, p)) END AS left_words FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(left_words, ' ')) AS kept_sha256 FROM kept
"""

OP5_SQL = r"""
WITH w AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS shuffle FROM documents),
named AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS k FROM w GROUP BY source),
weighted AS (SELECT source, source_size, CASE k WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, CAST(2 * source_size AS BIGINT) AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM named),
levels AS (SELECT *, cap / weight AS level,
    coalesce(CAST(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before,
    sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM weighted),
heights AS (SELECT *, (total * 1.5::DOUBLE - before) / ahead AS here, row_number() OVER (ORDER BY level, source ASC NULLS LAST) AS nth FROM levels),
filled AS (SELECT *, (SELECT arg_min(here, nth) FROM heights WHERE here <= level) AS water FROM heights),
quotas AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(water, 'inf'::DOUBLE) * weight) AS target FROM filled),
served AS (SELECT w.doc_id, w.source, w.size, w.shuffle, q.source_size, q.target, r.round,
    CAST(coalesce(sum(size) OVER (PARTITION BY r.round, w.source ORDER BY shuffle, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + r.round * q.source_size AS pos
  FROM w JOIN quotas q ON w.source IS NOT DISTINCT FROM q.source CROSS JOIN (VALUES (0), (1)) r(round)),
parts AS (SELECT *, greatest(0, least(size, CAST(floor(target) AS BIGINT) - pos)) AS words FROM served),
placed AS (SELECT doc_id, source, round, size, source_size, target, words,
    CASE WHEN words > 0 THEN coalesce(sum(words) FILTER (words > 0) OVER (ORDER BY (words > 0) DESC, least(1.0::DOUBLE, (pos + words) / target), source ASC NULLS LAST, round, shuffle, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS mix_offset FROM parts)
SELECT doc_id, size, source_size, target, CAST(sum(words) AS BIGINT) AS taken, CAST(min(mix_offset) AS BIGINT) AS mix_offset FROM placed GROUP BY doc_id, size, source_size, target
"""

#: Among equal weights the smallest exponential draw is the greatest hash; a new region weighs a quarter of the others.  CRC-32 goes byte by byte over the text's hex digits.
OP6_SQL = r"""
WITH RECURSIVE bits AS (SELECT i AS n, i::UBIGINT AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
docs AS (SELECT doc_id, coalesce(text, '') AS text, hex(coalesce(text, '')) AS digits, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key FROM documents),
sums AS (SELECT doc_id, key, CAST(strlen(text) + 1 AS BIGINT) AS size,
    CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(digits), 2), lambda i: ('0x' || substr(digits, i, 2))::UBIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) AS BIGINT) AS text_crc32 FROM docs, crc),
draws AS (SELECT *, list_transform(['g0', 'g1', 'g2', 'g3', 'x16'], lambda g: ('0x' || substr(md5(key || '/root/' || g), 1, 13))::BIGINT) AS tops FROM sums),
tops AS (SELECT *, list_position(tops[1:4], list_max(tops[1:4])) - 1 AS region, -ln((tops[5] + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) < -ln((list_max(tops[1:4]) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / 4 AS grown FROM draws),
racks AS (SELECT *, list_transform([0, 1], lambda k: ('0x' || substr(md5(key || '/g' || region || '/k' || k), 1, 13))::BIGINT) AS ks FROM tops),
racked AS (SELECT *, CASE WHEN ks[1] >= ks[2] THEN 0 ELSE 1 END AS rack FROM racks),
leaves AS (SELECT *, list_transform([0, 1], lambda s: ('0x' || substr(md5(key || '/g' || region || '/k' || rack || '/' || s), 1, 13))::BIGINT) AS ss FROM racked),
placed AS (SELECT *, CAST(4 * region + 2 * rack + CASE WHEN ss[1] >= ss[2] THEN 0 ELSE 1 END AS INTEGER) AS shard FROM leaves)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(key), 1, 8))::BIGINT % 1024, doc_id, text_crc32, size) - 1 AS slot,
    CASE WHEN grown THEN 16 ELSE shard END AS grown_shard FROM placed
"""

OP9_SQL = r"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER () AS own FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, q.own, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.own <> c.own AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id ASC NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLE_SQL: dict[str, str] = {"op1_url_filter": OP1_SQL, "op4_substring_dedup": OP4_SQL, "op5_mixing": OP5_SQL, "op6_sharding": OP6_SQL, "op9_neighbours": OP9_SQL}
