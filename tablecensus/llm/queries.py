"""The registered queries of these operators, each over its whole table."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination,
    hard_negatives,
    line_dedup,
    mixing,
    near_dedup,
    personal_data,
    quality_model,
    quality_rules,
    substring_dedup,
    tokens,
    toxicity,
    url_filters,
    whitening,
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_json() -> str:
    import public_tokenizers

    return Path(public_tokenizers.path("word_bpe_49k.json")).read_text()


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(read(spark, sf_dir, "documents")).drop("kept")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"), tokenizer_json())


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("values " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filters.RULES)).toDF("host", "path", "verdict")
    return url_filters.url_filters(read(spark, sf_dir, "pages"), rules)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.benchmark_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(read(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_line_dedup": op1,
    "op2_mixing": op2,
    "op3_near_dedup": op3,
    "op4_substring_dedup": op4,
    "op5_token_counts": op5,
    "op6_url_filters": op6,
    "op7_quality_model": op7,
    "op8_toxicity": op8,
    "op9_quality_rules": op9,
    "op10_decontamination": op10,
    "op11_whitening": op11,
    "op12_personal_data": op12,
    "op13_hard_negatives": op13,
}
