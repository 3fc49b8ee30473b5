"""A corpus pipeline: quality, line dedup, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import itertools
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.bpe_codec import encode_documents
from roadloom.llm.gam_quality import accepted
from roadloom.llm.latent_decontamination import clean_documents
from roadloom.llm.line_dedup import line_dedup
from roadloom.llm.parity_join import parity_join
from roadloom.llm.samples import remainder
from roadloom.session import checkpoint_dir, removed


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model accepts; it learns from the labels of the training folds.

    Null and empty texts and rows without an id are scored like others, repeated rows are judged alike; without both labels
    all rows stay. An empty table gives none."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 3) != 1)
    return accepted(docs, labels.select("doc_id", F.col("quality").alias("label")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated line windows; documents of which no word is left go. n_chars follows the text.

    Rows that lost nothing stay as they are, null and empty texts among them; rows that repeat a doc_id are one document.
    Columns of any name stay the document's own."""
    gone = next(c for i in itertools.count() if (c := f"_lines_{i}") not in docs.columns)
    out = line_dedup(docs, (f"{gone}_all", gone)).where(rf"{gone} = 0 or text rlike '[^\\x20\\x09-\\x0D]'")
    return out.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of linked documents.

    Rows without an id stay, so do null and empty texts, which link with nothing; rows that repeat the smallest doc_id of
    their group stay each."""
    gone = parity_join(docs.select("doc_id", "text")).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; null and empty texts hold none. Repeated rows are judged alike, and an
    empty benchmark leaves all rows."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their number and digests; a null text has none. A row for every row."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("tokens", tokens)]

#: The stages hold models and encoders that SQL can't express; they are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each result written to the session's shared folder and read again. What a stage
    left goes when the next one is written; the last result stays for the caller."""
    at = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            removed(spark, before)
        before = f"{at}/{name}"
    return docs
