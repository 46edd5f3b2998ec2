"""Checks of a tree of markdown documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import markdown as M
from tessella.functions.names import basename, bound, dirname, has, link_path

REQUIRED_FIELDS = ("name", "type", "description")
TYPES = ("rule", "index", "meta")
REQUIRED_SECTIONS = ("Общие правила", "Расположение", "Чек-лист для проведения ревью кода")


def parsed(docs: DataFrame) -> DataFrame:
    """docs (path, content) with fields (map or null) and body."""
    return docs.select("path", M.front_matter(F.col("content")).alias("fields"), M.body(F.col("content")).alias("body"))


def _said(docs: DataFrame, say: Callable[[Column, Column], Column]) -> DataFrame:
    """(path, x): a row for each item of say(fields, body), of documents that are parsed once.

    The outer array has one item always, so that the optimizer infers no filter that would say all twice, and moves none
    that would parse below a shuffle."""
    content = F.col("content")
    parts = F.struct(M.front_matter(content).alias("fields"), M.body(content).alias("body"))
    return docs.select("path", F.explode(F.array(bound(parts, lambda p: say(p["fields"], p["body"])))).alias("_all")).select("path", F.explode("_all").alias("x"))


def _field(fields: Column, name: str) -> Column:
    return F.try_element_at(fields, F.lit(name))


def _matter(fields: Column) -> Column:
    """What is wrong with a front matter."""
    field = lambda n: F.coalesce(_field(fields, n), F.lit(""))
    found = [F.when(F.trim(field(n)) == "", F.lit(f"missing {n}")) for n in REQUIRED_FIELDS] + [F.when(~field("type").isin(*TYPES), F.concat(F.lit("type "), field("type")))]
    return F.when(fields.isNull(), F.array(F.lit("missing"))).otherwise(F.filter(F.array(*found), lambda x: x.isNotNull()))


def _linked(body: Column) -> Column:
    """array of struct(line, text, target, resolved) of links to other documents."""
    return F.transform(M.links(body), lambda x: F.struct(x["line"].alias("line"), x["text"].alias("text"), x["target"].alias("target"), link_path(dirname(F.col("path")), x["target"]).alias("resolved")))


def _lacking(fields: Column, body: Column, sections: tuple[str, ...]) -> Column:
    """The sections that a rule document lacks."""

    def lack(headings: Column, section: str) -> Column:
        return F.when(~F.exists(headings, lambda h: M.heading_matches(h, F.lit(section))), F.lit(section))

    lacks = bound(M.headings(body), lambda h: F.filter(F.array(*[lack(h, s) for s in sections]), lambda x: x.isNotNull()))
    return F.when(_field(fields, "type") == "rule", lacks)


def front_matter_errors(docs: DataFrame) -> DataFrame:
    """(path, detail): no front matter, a required field that is missing or blank, a type that there isn't."""
    return _said(docs, lambda fields, body: _matter(fields)).select("path", F.col("x").alias("detail"))


def naming_errors(entries: DataFrame) -> DataFrame:
    """(path, detail) for files and directories with an underscore in their name."""
    return entries.filter(has(basename(F.col("path")), "_")).select("path", F.when(F.col("is_dir"), "directory").otherwise("file").alias("detail"))


def internal_links(docs: DataFrame) -> DataFrame:
    """(path, line, text, target, resolved) of links to other documents. Lines are counted from the body's first."""
    return _said(docs, lambda fields, body: _linked(body)).select("path", "x.line", "x.text", "x.target", "x.resolved")


def broken_links(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, line, target): links to what isn't in entries (files and directories)."""
    # Paths may be made of keys, so that nobody knows their size before: they are never broadcast.
    there = entries.select(F.col("path").alias("resolved"))
    return internal_links(docs).filter("resolved <> ''").join(there.hint("merge"), "resolved", "left_anti").select("path", "line", "target")


def missing_sections(docs: DataFrame, sections: tuple[str, ...] = REQUIRED_SECTIONS) -> DataFrame:
    """(path, detail): sections that a rule document lacks."""
    return _said(docs, lambda fields, body: _lacking(fields, body, sections)).select("path", F.col("x").alias("detail"))


def all_errors(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """(check, path, line, detail) of all checks, for which documents are read once. What is no link is broken by no entry:
    it goes through the same join, by its own path."""
    no_line = F.lit(None).cast("int")
    row = lambda check, line, detail, resolved: F.struct(F.lit(check).alias("check"), line.alias("line"), detail.alias("detail"), resolved.alias("resolved"))
    some = lambda rows: F.coalesce(rows, F.array().cast("array<struct<check:string,line:int,detail:string,resolved:string>>"))

    def say(fields: Column, body: Column) -> Column:
        own = F.col("path")
        links = F.transform(F.filter(_linked(body), lambda x: x["resolved"] != ""), lambda x: row("link", x["line"], x["target"], x["resolved"]))
        return F.concat(
            some(F.transform(_matter(fields), lambda d: row("front-matter", no_line, d, own))),
            some(links),
            some(F.transform(_lacking(fields, body, REQUIRED_SECTIONS), lambda d: row("section", no_line, d, own))),
        )

    there = entries.select(F.lit("link").alias("check"), F.col("path").alias("resolved"))
    said = _said(docs, say).select("path", "x.check", "x.line", "x.detail", "x.resolved")
    of_documents = said.join(there.hint("merge"), ["resolved", "check"], "left_anti").select("check", "path", "line", "detail")
    return of_documents.unionByName(naming_errors(entries).select(F.lit("naming").alias("check"), "path", no_line.alias("line"), "detail"))


def totals(errors: DataFrame) -> DataFrame:
    """(check, n) with a row 'total'; checks without an error have 0."""
    of = lambda c: F.coalesce(F.sum((F.col("check") == c).cast("long")), F.lit(0)).cast("long")
    names = ("front-matter", "naming", "link", "section")
    counted = errors.agg(*[of(c).alias(c) for c in names], F.count(F.lit(1)).alias("total"))
    return counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in (*names, "total")])).alias("x")).select("x.*")
