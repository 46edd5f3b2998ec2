"""Rendezvous hashing of record keys over weighted shards, by built-in functions only.

Each shard i with weight w_i scores a key by -w_i / ln(u), u in (0, 1) from a hash of the key and i; the highest score
takes the record. A record's shard depends on its key and the shards alone, and a new shard only takes records into
itself. u comes from 52 bits of MD5, so that other engines can compute the same shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Parts of a shard that are numbered apart from each other; a slot is the part's offset plus the place in it.
PARTS = 256
OVERHEAD = 16


def _score(key: Column, shard: Column, weight: Column) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", key, shard.cast("string"))), 1, 13), 16, 10).cast("double")
    return -weight / F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52)))


def _best(key: Column, weights: Sequence[float]) -> Column:
    table = F.array(*[F.struct(F.lit(float(w)).alias("w"), F.lit(i).alias("i")) for i, w in enumerate(weights)])
    return F.array_max(F.transform(table, lambda s: F.struct(_score(key, s["i"], s["w"]).alias("score"), (-s["i"]).alias("minus"))))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key, an int from 0. Ties go to the lower shard; a null key is a key of its own (the empty text)."""
    return (-_best(F.coalesce(key.cast("string"), F.lit("")), weights)["minus"]).cast("int")


def shard(docs: DataFrame, n_shards: int = 40, weights: Sequence[float] | None = None, new_weight: float = 1.0, parts: int = PARTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    weights: one for each shard (all 1 where not given). slot numbers a shard's rows from 0 without gaps, by the part
    (a hash of the key and the text's CRC, so that the rows of one key don't meet in one part) and doc_id; repeated rows get
    slots of their own. grown_shard is the shard once one more shard of
    new_weight is added. A null text has size 16 and CRC 0; a null doc_id counts as one key; an empty table gives no
    rows. Only the row count of each of n_shards * parts parts is broadcast, which doesn't grow with the data.
    """
    weights = [1.0] * n_shards if weights is None else list(weights)
    if len(weights) != n_shards or min(weights) <= 0:
        raise ValueError("weights: one positive number for each shard")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    new = _score(key, F.lit(n_shards), F.lit(float(new_weight)))
    ids = (
        docs.select(F.col("doc_id"), F.col("text"))
        .withColumn("_best", _best(key, weights))
        .select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(OVERHEAD)).alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
            (-F.col("_best")["minus"]).cast("int").alias("shard"),
            F.when(new > F.col("_best")["score"], F.lit(n_shards)).otherwise(-F.col("_best")["minus"]).cast("int").alias("grown_shard"),
        )
        .withColumn("_part", (F.conv(F.substring(F.md5(F.concat_ws(":", key, F.col("text_crc32").cast("string"))), 1, 8), 16, 10).cast("long") % parts).cast("int"))
    )
    before = W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = ids.groupBy("shard", "_part").count().select("shard", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    within = W.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32", "size")
    return (
        ids.withColumn("_place", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), ["shard", "_part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_offset") + F.col("_place")).cast("long").alias("slot"), "grown_shard")
    )


def oracle(n_shards: int = 40, parts: int = PARTS) -> str:
    """DuckDB SQL for shard() with equal weights."""
    table = [0] * 256
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table[i] = c
    return f"""
WITH t AS (SELECT [{", ".join(map(str, table))}]::BIGINT[] AS crc),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, '') AS key FROM documents),
s AS (
  SELECT rid, i, -1.0 / ln((('0x' || substr(md5(key || ':' || i), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS score
  FROM d, range({n_shards + 1}) r(i)),
a AS (SELECT rid, arg_max(i, score) FILTER (i < {n_shards}) AS shard, arg_max(i, score) AS grown FROM s GROUP BY rid),
r AS (
  SELECT doc_id, octet_length(encode(text))::BIGINT + {OVERHEAD} AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c & 255, b) + 1)::INT]))) AS text_crc32,
    shard::INT AS shard, grown::INT AS grown_shard, key
  FROM d JOIN a USING (rid), t)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(key || ':' || text_crc32), 1, 8))::BIGINT % {parts}, doc_id, text_crc32, size) - 1 AS slot
FROM r
"""
