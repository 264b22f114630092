"""Documents to a training set: each stage's table is written as Parquet and read again by the next one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from faultgauge.llm import bpe, mixing, order_minhash, quality, queries, suffix_dedup
from faultgauge.llm.common import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.accepted(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return order_minhash.deduplicated(docs)


#: Bytes of a repeated string to cut. Of the runs of 51 words in sf0.1, 99 in 100 are longer in each language; op5 has 400.
PASSAGE_BYTES = 200


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str, length: int = PASSAGE_BYTES) -> DataFrame:
    """Strings of ``length`` bytes that occur more than once are cut out everywhere: passages of over 50 words with them."""
    return suffix_dedup.deduplicated(docs, length)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of languages that fall short of their weight are repeated; every document stays."""
    return mixing.mixed(docs, queries.labelled_languages(spark, sf_dir), queries.LANGUAGES)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of what is left."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", good_quality),
    ("near_copies", one_of_near_copies),
    ("repeats", without_repeats),
    ("mixing", to_weights),
    ("byte_bpe", encoded),
]

#: The classifier, the components and the rates are iterative; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
