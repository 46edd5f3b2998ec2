"""Scalar calculators as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of arrays of numbers, in doubles. Unequal lengths and zero norms are errors."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    add = lambda s, v: s + v
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), add)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, p: s + p * p))
    return F.when(F.size(x) != F.size(y), F.raise_error(F.lit("vectors of unequal lengths")).cast("double")).otherwise(dot / (norm(x) * norm(y)))


def truncated(value: Column, scale: int) -> Column:
    """A decimal cut, not rounded, to scale places."""
    cut = lambda v: F.floor(v, F.lit(scale))
    return F.when(value < 0, -cut(-value)).otherwise(cut(value))


def discounted(amount: Column, kind: Column, value: Column) -> Column:
    """The discount on an amount: a percentage of it or fixed, at least 0, at most the amount, cut to 6 places."""
    a, v = amount.cast("decimal(18,6)"), value.cast("decimal(18,6)")
    raw = F.when(kind == "percent", truncated(truncated((a * v).cast("decimal(38,12)"), 8) / F.lit(100).cast("decimal(3,0)"), 6)).otherwise(v)
    return F.greatest(F.least(raw.cast("decimal(18,6)"), a), F.lit(0).cast("decimal(18,6)"))


UNITS = ("B", "KB", "MB", "GB", "TB")


def size_text_loop(n: Column) -> Column:
    """Bytes as text: divided by 1024 while over 1024, so that 1024 stays in bytes; two places at most."""
    out = n.cast("string")
    value, text = n.cast("double"), None
    for i, unit in enumerate(UNITS):
        scaled = F.concat(_plain(F.round(value / F.lit(1024.0**i), 2)), F.lit(f" {unit}"))
        last = i == len(UNITS) - 1
        here = (value / F.lit(1024.0**i)) <= 1024
        text = F.when(here, scaled) if text is None else text.otherwise(scaled) if last else text.when(here, scaled)
    return F.when(out.isNotNull(), text)


def size_text_log(n: Column) -> Column:
    """Bytes as text by the power of 1024, so that 1024 is 1 KB; two places at most."""
    value = n.cast("double")
    power = F.least(F.when(value >= 1, F.floor(F.log(value) / F.log(F.lit(1024.0)) + F.lit(1e-12))).otherwise(0), F.lit(len(UNITS) - 1)).cast("int")
    return F.concat(_plain(F.round(value / F.pow(F.lit(1024.0), power), 2)), F.lit(" "), F.element_at(F.array(*map(F.lit, UNITS)), power + 1))


def _plain(x: Column) -> Column:
    """A number without zeros after its last place."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", x), "0+$", ""), r"\.$", "")


def within_minutes(moment: Column, minutes: int, now: Column) -> Column:
    """Whether minutes have passed since a moment."""
    return F.coalesce(moment + F.make_dt_interval(mins=F.lit(minutes)) <= now, F.lit(False))


def email(text: Column) -> Column:
    """A trimmed, lower-cased address, or null where it isn't one."""
    plain = F.lower(F.trim(text))
    return F.when(plain.rlike(r"^[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+$"), plain)


def fixed10(value: Column) -> Column:
    """A number as text with ten places, rounded."""
    return value.cast("decimal(38,10)").cast("string")


def timestamp_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def attempt(redeliveries: Column) -> Column:
    """The number of a message's attempt."""
    return F.coalesce(redeliveries, F.lit(0)) + 1
