"""The library's filters as temporary SQL functions, which the optimizer inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name and arguments → type and expression.
FUNCTIONS = {
    "size_text(bytes BIGINT)": (
        "STRING",
        """CASE WHEN bytes <= 0 THEN '0 B' ELSE concat(
             regexp_replace(regexp_replace(format_string('%.2f', round(bytes / power(1024, least(floor(log2(bytes) / 10), 4)), 2)), '0+$', ''), '[.]$', ''), ' ',
             element_at(array('B', 'KB', 'MB', 'GB', 'TB'), CAST(least(floor(log2(bytes) / 10), 4) AS INT) + 1)) END""",
    ),
    "strip_extension(name STRING)": ("STRING", "regexp_replace(name, '[.][^.]*$', '')"),
    "base_name(path STRING)": ("STRING", "element_at(split(path, '/'), -1)"),
    "normal_email(text STRING)": (
        "STRING",
        """CASE WHEN lower(trim(text)) RLIKE "^[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:[.][a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+$" THEN lower(trim(text)) END""",
    ),
}


def register(spark: SparkSession) -> None:
    """Make FUNCTIONS known to the session; those of the same name are replaced."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
