"""A corpus from raw documents to packed training sequences.

Language ID drops what has no language, SimHash keeps one document of each
near-duplicate group, substring dedup removes passages that earlier documents
have, mixing serves the sources by weight, packing fills sequences.  Every
stage is written as Parquet and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, mixing, packing, simhash, substring
from tidemark.llm.common import cut, discard, pick
from tidemark.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Posterior below which a document counts as being in no learnt language.
LEAST_LANGUAGE = 0.3
#: Near-duplicates share 0.8 of their five-word shingles: such a pair differs in 19.5 of 128 SimHash bits on average, and
#: in 36 or fewer with a probability of 0.9999 (binomial); it meets in a table with probability RECALL at least.
SHINGLE, LANES, RADIUS, RECALL, SIMILARITY = 5, 2, 36, 0.999, 0.8
#: Passages as long as this many words are removed where they repeat.
PASSAGE, ANCHOR = 40, 8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learnt language.

    Null texts and texts without a letter go; ids play no part, and equal rows
    fare alike; without any language in the table all go.
    """
    return langid.keep(pick(docs, *COLUMNS), langid.train(docs), LEAST_LANGUAGE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each near-duplicate group.

    Null ids come after all others, of rows with one id and different texts each
    counts for itself, and of equal rows one stays; null and empty texts are
    copies of each other; an empty table stays empty.
    """
    return simhash.representatives(docs, COLUMNS, SHINGLE, LANES, RADIUS, RECALL, SIMILARITY)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has; others unchanged.

    Null texts stay null; a row with a null id neither loses words nor makes
    others lose any; rows that share an id do not count as each other's repeats.
    """
    kept = substring.remove_repeats(docs, PASSAGE, ANCHOR, keep=("text", "lang", "source", "n_chars"))
    text = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("text"))
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by target weight; a document served twice is there twice.

    Null texts and texts without a word are not served; a null source is one of
    its own; equal rows count each for itself.
    """
    return mixing.mixed(pick(docs, *COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences; a null text counts as empty, and each row is packed for itself."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("packed", packed)]

#: Language scores, fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
