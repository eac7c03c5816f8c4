"""Queries of the training-data operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trifold.llm import decontam, hilbert, licences, neardup, packing, pii, quality_fm, sketch, tokenbits, toxicity
from trifold.llm.common import table
from trifold.storage import spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table; one of a file or two is dealt to all cores."""
    return spread(table(spark, sf_dir, "documents"))


def op1_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.score_quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard_documents(documents(spark, sf_dir))


def op3_disclosure_sanitiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(documents(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op6_toxicity_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbits.token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_scaled_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(documents(spark, sf_dir))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), words=4)


def op10_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


QUERIES = {name: f for name, f in sorted(globals().items()) if name.startswith("op")}
ORACLE_SQL: dict[str, str] = {"op5_benchmark_decontamination": decontam.ORACLE_SQL}
