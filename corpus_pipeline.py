"""A corpus pipeline of four stages: language ID, SimHash near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import langid, mixing, packing, simhash
from palimpsest.llm.common import written

#: A document of which less than this share of n-grams belongs to its best language is in none of the languages.
LEAST_SCORE = 0.3
#: Texts are looked at for near copies with a similarity of 0.8 or more if one of PRINTS fingerprints differs in at most so
#: many bits. Two texts that similar are that near by a single fingerprint in some six of ten cases.
WIDE_BITS, PRINTS = 7, 2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language."""
    found = docs.withColumn("__language", langid.predict(F.col("text"), langid.train(docs), spark))
    return found.filter((F.col("__language.lang") != langid.UNKNOWN) & (F.col("__language.score") >= LEAST_SCORE)).drop("__language")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates.

    Fingerprints within 3 bits link as they are; texts of which any of PRINTS fingerprints are within WIDE_BITS, if they
    share 0.8 of their five-word shingles. Nulls and empty texts are one group; see :func:`simhash.keep_one` for null and
    repeated ids.
    """
    return simhash.keep_one(docs, wide_bits=WIDE_BITS, prints=PRINTS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents so that sources have words in proportion 1, 2, 3 and at most three epochs."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the mix to length buckets and token-budget batches."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("language ID", language_id), ("near dedup", near_dedup), ("mix sources", mix_sources), ("packing", pack)]

#: Fingerprints, learned filters and the optimal boundaries can't be expressed in SQL; tests hold brute force against them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
