"""Registered queries of the operators: each applies one to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.llm import ball_tree, bpe, decontaminate, fill_middle, jaccard_join, licenses, max_sketch, minhash, preferences, resampling, sharding, suffix_dedup, warc
from ragmill.llm._spark import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return kept.select("doc_id", "log_weight", "sample_key")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), length=100).drop("kept")


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preferences.assembled(preferences.segments(*preferences.negatives(table(spark, sf_dir, "conversations")), key="conv_id"))
    return pairs.withColumns({c: preferences.ranges(F.col(c)) for c in ("chosen_train", "rejected_train")})


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ids=False)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sharding.placed(docs, "doc_id", [f"shard-{i:03d}" for i in range(64)])


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.notices(spark))


def op11_max_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return max_sketch.search(max_sketch.build(docs), docs, table(spark, sf_dir, "benchmark"), k=20)


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_copies(table(spark, sf_dir, "documents"), n=3, num=85, den=100)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transformed(table(spark, sf_dir, "documents"))
    text = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


_QUERIES = (
    op1_decontaminate, op2_exact_top_k, op3_importance_resampling, op4_suffix_dedup, op5_preferences, op6_bpe, op7_sharding, op8_warc, op9_jaccard_join, op10_licenses,
    op11_max_sketch, op12_minhash, op13_fill_middle,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_top_k": ball_tree.ORACLE, "op5_preferences": preferences.ORACLE, "op8_warc": warc.ORACLE, "op9_jaccard_join": minhash.components_oracle(4, 85), "op10_licenses": licenses.ORACLE,
        "op11_max_sketch": max_sketch.ORACLE, "op12_minhash": minhash.ORACLE, "op13_fill_middle": fill_middle.ORACLE,
    }
