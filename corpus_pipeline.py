"""The corpus pipeline: quality, near copies, repeated strings, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ragmill.llm import bpe, decontaminate, jaccard_join, resampling, suffix_dedup
from ragmill.llm._spark import table, written

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws."""
    return resampling.resample(docs, table(spark, sf_dir, "labels")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.keep_one_per_group(docs, n=5, num=80, den=100)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes or more that occur earlier; n_chars follows the text."""
    return suffix_dedup.drop_repeats(docs, length=100)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return bpe.encode_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeats", repeats), ("contamination", contamination), ("tokens", tokens)]

#: No SQL expresses these stages; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
