"""Command line: checks of documents and sources, fixes, and the copies of an initialisation.

    python -m tessella.cli docs DIR            checks of markdown documents; exit code 1 if there are errors
    python -m tessella.cli sniff DIR...        rules over PHP sources, likewise
    python -m tessella.cli fix DIR... --out D  fixed sources as (path, content) rows in Parquet
    python -m tessella.cli init FROM TO        copies documents that aren't there; --force overwrites others too
"""

from __future__ import annotations

import argparse
import os
import shutil
import sys

from pyspark.sql import DataFrame, SparkSession

from tessella.operators import doc_rules, report, rules
from tessella.sources import files, php


def _said(errors: DataFrame, *columns: str) -> int:
    """Print errors in order, and their number by the first column; the exit code."""
    rows = errors.orderBy(*columns).toLocalIterator()
    counts: dict[str, int] = {}
    for r in rows:
        print(": ".join(str(r[c]) for c in columns if r[c] is not None))
        counts[r[columns[0]]] = counts.get(r[columns[0]], 0) + 1
    print(f"{sum(counts.values())} error(s)" + "".join(f", {k}: {n}" for k, n in sorted(counts.items())))
    return int(bool(counts))


def check_docs(spark: SparkSession, root: str) -> int:
    root = os.path.abspath(root)
    return _said(doc_rules.all_errors(files.markdown_files(spark, root), files.entries(spark, root)), "check", "path", "line", "detail")


def check_sources(spark: SparkSession, roots: list[str]) -> int:
    found = rules.violations(php.units(files.without_directories(files.php_files(spark, [*map(os.path.abspath, roots)]))))
    return _said(found, "rule", "path", "line", "code", "message")


def fix_sources(spark: SparkSession, roots: list[str], out: str) -> int:
    rules.fixed(php.units(files.php_files(spark, [*map(os.path.abspath, roots)]))).write.mode("overwrite").parquet(out)
    return 0


def initialise(spark: SparkSession, source: str, target: str, force: bool = False, keep: tuple[str, ...] = (), ignore: str | None = None) -> dict[str, int]:
    """Copy files by a plan; keep is never overwritten; a line is added to the target's ignore file once."""
    listed = lambda root: files.entries(spark, root).filter("NOT is_dir").selectExpr(f"substring(path, {len(root.rstrip('/')) + 2}) AS path")
    os.makedirs(target, exist_ok=True)
    plan = report.copy_plan(listed(source), listed(target), force, keep).collect()  # a row for each file of one directory tree
    for row in plan:
        if row.action != "skip":
            os.makedirs(os.path.dirname(os.path.join(target, row.path)), exist_ok=True)
            shutil.copyfile(os.path.join(source, row.path), os.path.join(target, row.path))
    if ignore:
        name = os.path.join(target, ".gitignore")
        before = open(name).read() if os.path.exists(name) else ""
        with open(name, "w") as out:
            out.write(report.with_entry(before, ignore))
    return {action: sum(r.action == action for r in plan) for action in ("copy", "update", "skip")}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessella", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("docs").add_argument("root")
    for name in ("sniff", "fix"):
        p = commands.add_parser(name)
        p.add_argument("roots", nargs="+")
        if name == "fix":
            p.add_argument("--out", required=True)
    p = commands.add_parser("init")
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--force", action="store_true")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("tessella").getOrCreate()
    if args.command == "docs":
        return check_docs(spark, args.root)
    if args.command == "sniff":
        return check_sources(spark, args.roots)
    if args.command == "fix":
        return fix_sources(spark, args.roots, args.out)
    print(initialise(spark, args.source, args.target, args.force))
    return 0


if __name__ == "__main__":
    sys.exit(main())
