"""The queries opN_<name>: each applies its operator, with production parameters, to whole tables under sf_dir."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm import line_dedup as lines
from roadloom.llm import parity_join as parity
from roadloom.llm import substring_dedup as substrings
from roadloom.llm.bpe_codec import encode_documents
from roadloom.llm.compression_bands import compression_bands
from roadloom.llm.gam_quality import quality_scores
from roadloom.llm.language_id import language_id
from roadloom.llm.latent_decontamination import contaminated
from roadloom.llm.samples import remainder
from roadloom.llm.token_counts import token_counts
from roadloom.llm.toxicity_gru import toxicity_scores


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(table(spark, sf_dir, "documents"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    out = toxicity_scores(table(spark, sf_dir, "documents"), labels.select("doc_id", F.col("toxic").alias("label")))
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op7_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.parity_join(table(spark, sf_dir, "documents"))


def op8_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id(docs, docs.where(remainder("doc_id", 3) != 1))
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op10_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1)
    out = quality_scores(table(spark, sf_dir, "documents"), labels.select("doc_id", F.col("quality").alias("label")))
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_substring_dedup, op3_line_dedup, op4_compression_bands, op5_bpe_codec, op6_toxicity_gru, op7_parity_join, op8_latent_decontamination, op9_language_id, op10_gam_quality)}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op2_substring_dedup": substrings.SQL, "op3_line_dedup": lines.SQL, "op7_parity_join": parity.SQL}
