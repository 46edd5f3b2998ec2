"""The queries of the operators: production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, decontam, gif, langid, lm, minhash, sharding, sitetree, tokcount, warc
from tessella.llm.shared import documents, pages


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), 40)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokcount.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return lm.score(docs, lm.split(docs))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(pages(spark, sf_dir))


def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature: frames, and the red channel's histogram of the drawn screen summed over the frames."""
    zero = F.array_repeat(F.lit(0).cast("long"), gif.BINS)
    red = F.aggregate("frames", zero, lambda a, f: F.zip_with(a, f["red"], lambda x, y: x + y))
    feature = F.concat(F.lit("frames="), F.size("frames").cast("string"), F.lit(";red="), F.array_join(F.transform(red, lambda x: x.cast("string")), ","))
    return gif.read(gif.store(documents(spark, sf_dir))).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=False)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(pages(spark, sf_dir))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), 4, 80)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.split_and_identify(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_decontamination, op3_lm_scoring, op4_warc, op5_token_counts, op6_gif, op7_byte_bpe, op8_html_extraction, op9_minhash, op10_language_id)}
ORACLES: dict[str, str] = {"op1_sharding": sharding.oracle(), "op9_minhash": minhash.oracle(4, 80)}
