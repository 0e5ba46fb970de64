"""Registered queries of this folder: thin digests of the operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cumulo.llm import (
    divergence, embedding_dedup, exact_dedup, language_model, minhash_dedup, mixing, packing, personal_data, quality, suffix_dedup, token_counts, toxicity, whitening,
)
from cumulo.llm.common import read


def vocabulary() -> str:
    """Path of the public byte-level vocabulary; the operators take any other as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.report(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(read(spark, folder, "documents"))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.decisions(read(spark, folder, "documents"))


def op4_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.report(read(spark, folder, "documents"))


def op5_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read(spark, folder, "documents")).drop("tie", "class")


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, folder, "documents"), vocabulary())


def op7_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, folder, "embeddings"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.report(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(read(spark, folder, "documents"), vocabulary())


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.deduplicate(read(spark, folder, "documents"))


def op11_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.report(read(spark, folder, "documents"))


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(read(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.report(read(spark, folder, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_mix_sources, op3_exact_dedup, op4_lm_score, op5_minhash_dedup, op6_token_counts, op7_embedding_dedup, op8_toxicity, op9_best_fit_packing, op10_suffix_dedup,
                                  op11_personal_data, op12_source_divergence, op13_whitening)}
SQL = {"op2_mix_sources": mixing.SQL, "op3_exact_dedup": exact_dedup.SQL, "op12_source_divergence": divergence.SQL}
