"""Small tables with what is odd: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(30_000))
CLASH = ["_text", "_lower", "shard", "slot", "size", "score", "set_id", "cid", "key", "train", "block", "_salt", "_hash", "_row", "bands", "held_out", "part", "_text_hash", "text_hash", "component_id", "media", "ids", "label", "id", "path"]


def odd_rows():
    rows = [(1, "one two three four five six seven", "en"), (2, None, "en"), (3, "", None), (4, "   \n\t ", "de"), (5, LONG, "en"), (6, LONG, "en"), (7, "Ünï çödé 漢字 \U0001f600 'll we'll x", "fr"), (None, "no id here at all today", "en"), (9, "one", "en"), (10, "one", "de"), (11, "1234 5678 !!", None)]
    return rows + [rows[0], rows[0], (12, "one two three four five six seven eight", None), (13, "ONE TWO THREE FOUR FIVE SIX SEVEN", None)]


def odd(spark, rows=None):
    """documents of the odd rows, with columns that clash with names used inside."""
    df = spark.createDataFrame([(i, t, x, "src", len(t or "")) for i, t, x in (odd_rows() if rows is None else rows)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


def empty(spark):
    return odd(spark, [])


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def words(text):
    out = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [w for w in __import__("re").split("[\x20\x09-\x0d]+", out) if w]
