"""Joins and look-ups over token rows; each stays within a file, so all share one partitioning by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.sources.php import EMPTY


def by_file():
    """The window of a file's tokens in order."""
    return W.partitionBy("path").orderBy("idx")


def direct_children(owners: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tokens whose innermost scope is an owner's, with the owner's columns as owner_*."""
    named = owners.select("path", F.col("idx").alias("parent_idx"), *[F.col(c).alias(f"owner_{c}") for c in ("line", "name", "code", "modifiers")])
    return tokens.drop("owner_idx").join(named, ["path", "parent_idx"])


def within_scope(owners: DataFrame, tokens: DataFrame) -> DataFrame:
    """(owner path, owner idx, token ...) for the tokens strictly between an owner's scope opener and closer."""
    o = owners.select("path", F.col("idx").alias("scope_idx"), F.col("scope_opener").alias("_from"), F.col("scope_closer").alias("_to"))
    t = tokens.select("path", "idx", "line", "code", "content", "name")
    return t.join(o, "path").filter("idx > _from AND idx < _to").drop("_from", "_to")


def next_of(codes: tuple[str, ...], value: Column) -> Column:
    """The value at the nearest following token of a kind in the same file."""
    return F.first(F.when(F.col("code").isin(*codes), value), ignorenulls=True).over(by_file().rowsBetween(1, W.unboundedFollowing))


def neighbours(tokens: DataFrame) -> DataFrame:
    """Effective tokens (no white space, no comments) with previous_code, next_code, next_content, next_next_*."""
    out = tokens.filter(~F.col("code").isin(*sorted(EMPTY)))
    for name, n in (("next", 1), ("second", 2), ("third", 3)):
        for c in ("code", "content"):
            out = out.withColumn(f"{name}_{c}", F.lead(c, n).over(by_file()))
    return out.withColumn("previous_code", F.lag("code").over(by_file()))
