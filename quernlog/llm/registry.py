"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read_table, scratch_path


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_vectors

    return near_vectors(read_table(spark, sf_dir, "embeddings"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(read_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "mix_epoch", "mix_turn", "mix_place", "mix_tokens", "mix_weight")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import apply_rules

    return apply_rules(read_table(spark, sf_dir, "documents"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_texts

    return score_texts(read_table(spark, sf_dir, "documents"))


def op9_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sstable import digest_shards, write_shards

    path = scratch_path(spark, "shards")
    write_shards(read_table(spark, sf_dir, "documents"), path)
    return digest_shards(spark, path)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similar_documents

    return similar_documents(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_packing": op1_packing, "op2_embeddings": op2_embeddings, "op3_pii": op3_pii, "op4_quality": op4_quality, "op5_mixing": op5_mixing, "op6_toxicity": op6_toxicity, "op7_rules": op7_rules, "op8_lm": op8_lm, "op9_sstable": op9_sstable, "op10_jaccard": op10_jaccard}


def oracle_sql() -> dict[str, str]:
    from .oracles import oracle_sql as known

    return known()
