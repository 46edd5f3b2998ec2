"""Class names and paths as Column functions. All tests are two-valued: a missing value is false, as in the rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One optional root of letters and underscores, then the module, its layer and the path in it.
MODULE_CLASS = r"^(?:[A-Za-z_]+\\)?Common\\Module\\([A-Za-z][A-Za-z0-9]*)\\(Domain|Application|Infrastructure|Integration)\\(.+)$"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use refers to it and wherever the optimizer moves it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def class_parts(name: Column) -> Column:
    """array('', module, layer, path), or null or an array of another size for a class outside the modules. One match gives all."""
    parts = F.split(F.regexp_replace(name, MODULE_CLASS, "\u0001$1\u0001$2\u0001$3"), "\u0001")
    return F.when(name.contains("Common\\Module\\"), parts)


def of_parts(parts: Column) -> dict[str, Column]:
    """module, layer and path of class_parts(), null for a class outside the modules; inside: whether it isn't."""
    inside = is_true(F.size(parts) == 4)
    return {"inside": inside, **{name: F.when(inside, F.get(parts, i)) for i, name in ((1, "module"), (2, "layer"), (3, "path"))}}


def parse_class(name: Column) -> Column:
    """struct(module, layer, path), or null for a class outside the modules."""
    return bound(class_parts(name), lambda x: F.when(F.size(x) == 4, F.struct(x[1].alias("module"), x[2].alias("layer"), x[3].alias("path"))))


def is_true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def starts(text: Column, *prefixes: str) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | text.startswith(p)
    return is_true(out)


def ends(text: Column, *suffixes: str) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | text.endswith(s)
    return is_true(out)


def has(text: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return is_true(out)


def slashes(path: Column) -> Column:
    """Backslashes as slashes."""
    return F.translate(path, "\\", "/")


def below_src(path: Column) -> Column:
    """The path from its leftmost src/ directory on, or null."""
    out = F.regexp_extract(path, "(^|/)(src/.*)$", 2)
    return F.when(out != "", out)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """What comes before the last slash; '.' where there is none."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def parent_name(path: Column) -> Column:
    """The name of the directory that a path lies in, or null."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def stem(path: Column) -> Column:
    """The file's name without its last extension."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def expected_namespace(below: Column) -> Column:
    """The namespace that a path below src/ stands for."""
    return F.translate(dirname(F.substring(below, 5, 1 << 30)), "/", "\\")


def fold_path(path: Column) -> Column:
    """A path without '.' and '..'; a relative one loses what would go above its beginning."""
    parts = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.array().cast("array<string>"))).when((p != "") & (p != "."), F.concat(acc, F.array(p))).otherwise(acc),
    )
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))


def link_path(directory: Column, target: Column) -> Column:
    """Where a link of a document in directory leads; '' for one to the document itself."""
    path = F.regexp_replace(target, "#.*", "")
    return F.when(path == "", "").otherwise(fold_path(F.concat(F.regexp_replace(directory, "/+$", ""), F.lit("/"), path)))
