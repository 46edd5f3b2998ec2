"""Counts of messages, comparisons with what was expected, and plans of copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def line_counts(messages: DataFrame, *keys: str) -> DataFrame:
    """Messages by line, whatever their column."""
    return messages.groupBy(*(keys or ("path",)), "line").agg(F.count(F.lit(1)).cast("int").alias("n"))


def message_map(messages: DataFrame) -> DataFrame:
    """(path, messages): a map from line to its messages, in the order of tokens."""
    by_line = messages.groupBy("path", "line").agg(F.array_sort(F.collect_list(F.struct("idx", "code", "message", "fixable"))).alias("all"))
    return by_line.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("line", "all")))).alias("messages"))


def by_file(messages: DataFrame, *order: str) -> DataFrame:
    """messages with nth, their place among their file's: in the order of tokens, rules and codes, or that given, nulls first."""
    keys = [F.col(c).asc_nulls_first() for c in order or ("line", "idx", "rule", "code")]
    return messages.withColumn("nth", F.row_number().over(W.partitionBy("path").orderBy(*keys)).cast("long"))


def differences(expected: DataFrame, actual: DataFrame, *keys: str) -> DataFrame:
    """(keys, line, expected, actual), in the order of keys and lines, where the counts n of two tables differ; a missing one is 0."""
    on = [*keys, "line"]
    a, b = expected.select(*on, F.col("n").alias("expected")), actual.select(*on, F.col("n").alias("actual"))
    both = a.join(b, on, "full_outer").select(*on, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return both.filter("expected <> actual").orderBy(*on)


def verdict(errors: DataFrame) -> DataFrame:
    """One row (errors, exit_code)."""
    return errors.agg(F.count(F.lit(1)).alias("errors"), F.when(F.count(F.lit(1)) > 0, 1).otherwise(0).alias("exit_code"))


def copy_plan(source: DataFrame, target: DataFrame, force: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, action): copy what isn't there; update what is only where forced, and never a path in keep."""
    there = target.select("path", F.lit(True).alias("_there")).distinct()
    action = F.when(F.col("_there").isNull(), "copy").when(F.lit(force) & ~F.col("path").isin(*keep) if keep else F.lit(force), "update").otherwise("skip")
    return source.select("path").join(there, "path", "left").select("path", action.alias("action"))


def plan_counts(plan: DataFrame) -> DataFrame:
    """One row (copied, updated, skipped)."""
    of = lambda a: F.coalesce(F.sum((F.col("action") == a).cast("long")), F.lit(0))
    return plan.agg(of("copy").alias("copied"), of("update").alias("updated"), of("skip").alias("skipped"))


def with_entry(text: str, entry: str) -> str:
    """A text file with a line appended, unless it is in it already."""
    return text if entry in text else text + ("" if not text or text.endswith("\n") else "\n") + entry + "\n"
