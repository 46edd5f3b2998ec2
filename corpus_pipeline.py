"""Pipeline over the documents: language, near duplicates, benchmark leaks, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, decontam, langid, minhash
from tessella.llm.shared import documents, mark, release, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is determined. The model learns from the labelled ones among docs."""
    return langid.accepted(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: five-word shingles, similarity of 0.8 or more."""
    return minhash.deduplicated(docs, 5, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, offsets, ids_sha256, decoded_sha256 of every document left."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]

#: SQL can't express the classifier, the alignment and the merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir.

    Every other stage is written to the shared folder and read again, and what it and the stages before it have written
    is deleted then. Documents are kept or dropped whole; null ids and repeated rows are each stage's affair; an empty
    table gives no rows.
    """
    docs, begun = documents(spark, sf_dir), mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        release(spark, begun, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
