"""Front matter, links and headings of markdown text as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.names import bound

LINK = r"\[([^\]]+)\]\(([^)]+)\)"


def _closing(content: Column) -> Column:
    """Where the closing line of the front matter begins (from 1); 0 for none. It is looked for from the fifth character."""
    return F.when(content.startswith("---\n"), F.locate("\n---\n", content, 5)).otherwise(0)


def has_front_matter(content: Column) -> Column:
    return F.coalesce(_closing(content) > 0, F.lit(False))


def body(content: Column) -> Column:
    """What follows the front matter; all where there is none."""
    return F.when(has_front_matter(content), content.substr(_closing(content) + 5, F.length(content))).otherwise(content)


def front_matter(content: Column) -> Column:
    """map of fields, or null without front matter. Of a key given twice the last value counts; quotes around are dropped."""
    yaml = content.substr(F.lit(5), F.greatest(_closing(content) - 5, F.lit(0)))
    lines = F.filter(F.transform(F.split(yaml, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#") & x.contains(":"))
    pair = lambda x: F.struct(
        F.trim(F.substring_index(x, ":", 1)).alias("key"),
        F.regexp_replace(F.trim(x.substr(F.locate(":", x) + 1, F.length(x))), r"""^["'](.*)["']\s*$""", "$1").alias("value"),
    )
    last = lambda fields: F.filter(fields, lambda f, i: ~F.exists(F.slice(fields, i + 2, F.size(fields)), lambda g: g["key"] == f["key"]))
    return F.when(has_front_matter(content), F.map_from_entries(bound(F.transform(lines, pair), last)))


def links(text: Column) -> Column:
    """array of struct(text, target, line): links to other documents, line by line, from line 1."""
    found = lambda line, i: F.transform(
        F.arrays_zip(F.regexp_extract_all(line, F.lit(LINK), 1).alias("t"), F.regexp_extract_all(line, F.lit(LINK), 2).alias("u")),
        lambda z: F.struct(z["t"].alias("text"), z["u"].alias("target"), (i + 1).cast("int").alias("line")),
    )
    # A line without the middle of a link has none.
    each = F.transform(F.split(text, "\n"), lambda line, i: F.when(line.contains("]("), found(line, i)).otherwise(F.array().cast("array<struct<text:string,target:string,line:int>>")))
    return F.filter(F.flatten(each), lambda x: ~x["target"].rlike("^(https?:|mailto:|#|tel:)") & ~x["target"].contains("{"))


def headings(text: Column) -> Column:
    """array of the texts of second-level headings."""
    return F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike("^## .+")), lambda x: F.trim(F.regexp_extract(x, "^## (.+)", 1)))


def heading_matches(heading: Column, required: Column) -> Column:
    """Equal without case, spaces and dots at the end, or beginning with the required heading's first word."""
    plain = lambda x: F.lower(F.rtrim(x, F.lit(" .")))
    return (plain(heading) == plain(required)) | plain(heading).startswith(F.split(plain(required), " ")[0])
