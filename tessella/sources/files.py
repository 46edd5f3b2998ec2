"""Files and directories as rows."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessella.functions.names import basename, slashes
from tessella.schemas import ENTRIES


def _plain(path: F.Column) -> F.Column:
    """A path without the scheme that a reader puts before it."""
    return F.regexp_replace(path, "^file:/+", "/")


def read_files(spark: SparkSession, roots: list[str], glob: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, content) of text files below roots whose names match glob, but for paths that match an exclude pattern."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(roots)
    out = found.select(_plain(F.col("path")).alias("path"), F.decode("content", "UTF-8").alias("content"))
    for pattern in exclude:
        out = out.filter(~F.col("path").rlike(pattern))
    return out


def markdown_files(spark: SparkSession, root: str, exclude: tuple[str, ...] = ("AGENTS.md",)) -> DataFrame:
    """Markdown documents below root without those of the excluded names. Their order is that of what is said of them:
    whole documents aren't sorted."""
    return read_files(spark, [root], "*.md").filter(~basename(F.col("path")).isin(*exclude))


def php_files(spark: SparkSession, roots: list[str], exclude: tuple[str, ...] = (r".*tests.*",)) -> DataFrame:
    """PHP sources below roots, but for excluded paths."""
    return read_files(spark, roots, "*.php", exclude)


def without_directories(files: DataFrame, directories: tuple[str, ...] = ("vendor", "var", "bin")) -> DataFrame:
    """files but for those below a directory of the given names."""
    return files.filter(~slashes(F.col("path")).rlike("(^|/)(" + "|".join(directories) + ")/"))


def entries(spark: SparkSession, root: str) -> DataFrame:
    """(path, is_dir, basename, extension) of everything below root. Spark's readers list no directories: one walk does."""
    rows = [(p := os.path.join(at, n), is_dir, n, None if is_dir else os.path.splitext(n)[1][1:]) for at, dirs, names in os.walk(root) for is_dir, group in ((True, dirs), (False, names)) for n in group]
    return spark.createDataFrame(rows, ENTRIES)


def existing(paths: DataFrame, entries_: DataFrame) -> DataFrame:
    """paths with exists: whether there is a file or directory of that path."""
    return paths.join(entries_.select("path", F.lit(True).alias("_there")).distinct(), "path", "left").withColumn("exists", F.coalesce("_there", F.lit(False))).drop("_there")


def decoded(responses: DataFrame, schema: str, column: str = "body") -> DataFrame:
    """Bodies of an external service's responses as structs; one that can't be decoded is an error."""
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"})
    return responses.withColumn("decoded", F.when(F.try_parse_json(F.col(column)).isNull() & F.col(column).isNotNull(), F.raise_error(F.lit("the response can't be decoded"))).otherwise(parsed))


class ExternalError(RuntimeError):
    """A call of an external service failed: its transport, its status or the decoding of its answer."""


def post(url: str, timeout: float = 3.0, headers: dict[str, str] | None = None) -> Callable[[str], str]:
    """A call that posts a JSON body and returns the answer's."""

    def send(body: str) -> str:
        asked = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json", **(headers or {})}, method="POST")
        with urllib.request.urlopen(asked, timeout=timeout) as answer:
            return answer.read().decode()

    return send


def external(requests: DataFrame, send: Callable[[str], str], schema: str) -> DataFrame:
    """requests with response: the struct that a service answers, each row's columns being posted as JSON. Whatever fails
    is raised as an ExternalError. Rows are sent one after another within a partition, and again if a task is."""
    kind = StructType.fromDDL(schema)
    columns = requests.columns
    asked = requests.withColumn("_body", F.to_json(F.struct(*columns)))
    out = StructType([*requests.schema.fields, StructField("_answer", StringType())])

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = []
            for body in batch.column(batch.num_columns - 1).to_pylist():
                try:
                    answers.append(json.dumps(json.loads(send(body))))
                except Exception as e:
                    raise ExternalError(f"{type(e).__name__}: {e}") from e
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(answers, pa.string())], [*columns, "_answer"])

    answered = asked.mapInArrow(call, out)
    parsed = F.from_json("_answer", kind, {"mode": "FAILFAST"})
    return answered.select(*columns, parsed.alias("response"))
