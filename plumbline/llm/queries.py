"""Registered queries of the text operators with their DuckDB text.

Each reads its whole tables and runs its operator with production parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontamination, fingerprints, hard_negatives, language_id, license, line_dedup, merkle, mixing, secrets, sharding, simhash, suffix_dedup, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "n_segments")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.component_rows(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op9_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan_licenses(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_proofs(table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


ENTRIES: dict[str, tuple[Query, str | None]] = {
    "op1_toxicity": (op1_toxicity, None),
    "op2_fingerprints": (op2_fingerprints, None),
    "op3_simhash": (op3_simhash, None),
    "op4_secrets": (op4_secrets, None),
    "op5_decontamination": (op5_decontamination, decontamination.HITS_SQL),
    "op6_language_id": (op6_language_id, None),
    "op7_line_dedup": (op7_line_dedup, line_dedup.LINES_SQL),
    "op8_mixing": (op8_mixing, mixing.mixture_sql()),
    "op9_license": (op9_license, None),
    "op10_sharding": (op10_sharding, None),
    "op11_merkle": (op11_merkle, merkle.PROOFS_SQL),
    "op12_suffix_dedup": (op12_suffix_dedup, None),
    "op13_hard_negatives": (op13_hard_negatives, hard_negatives.NEGATIVES_SQL),
}
