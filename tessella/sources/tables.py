"""Tables as they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes for each core under which a table may well be one row group, which no number of splits parts.
SMALL = 4 << 20


#: Bytes of keys for one task where each key is written out into a file: some thousands of files.
KEYS = 1 << 15


def spread(df: DataFrame, *keys: str, part: int | None = None) -> DataFrame:
    """A small table over all cores, by a hash of keys; a larger one is left as it is, without a shuffle.

    part: bytes for a task, for rows that are cheap to move and dear to work on. Any table is then spread, over as many
    tasks as it has such parts, so that no task grows with the table."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = cores if part is None else max(cores, -(-size // part))
    return df.repartition(tasks, *[F.xxhash64(F.col(k)) for k in keys]) if part is not None or size < cores * SMALL else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
