"""Session helpers: the shared folder, Arrow batch bounds and column checks."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.tables import spread, table

#: Rows in one Arrow batch. With documents of up to some hundred KB a batch stays within tens of MB.
BATCH_ROWS = 1000
#: Bytes in one Arrow batch, whatever the number of rows.
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that long texts can't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@cache
def _trim() -> Callable[[int], int] | None:
    """glibc's malloc_trim, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def returning(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives freed memory back to the system after a partition: Python workers go on to other stages, and would
    keep the most that any of them has had."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if (trim := _trim()) is not None:
            trim(0)

    return runs


_made: list[str] = []


def mark() -> int:
    """Where what is written from now on begins, for release()."""
    return len(_made)


def release(spark: SparkSession, begun: int = 0, keep: int = 0) -> None:
    """Delete what operators have written into the shared folder: all, or since mark() gave begun, but for the last keep tables.

    An operator deletes its own steps once its last table is written. What it returns reads that table: release() the rest
    once results are read or kept elsewhere."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = _made[begun : len(_made) - keep]
    del _made[begun : len(_made) - keep]
    for folder in gone:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the one that all executors share (spark.checkpoint.dir); in local mode a local one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        there = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = there.get() if there.isDefined() else None
    if base is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(base)
        atexit.register(shutil.rmtree, base.removeprefix("file://"), True)
    _made.append(f"{base.rstrip('/')}/{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """written(), in parts by a hash of key: groups and joins by key with as many parts then read it without a shuffle."""
    spark = df.sparkSession
    table_ = f"tessella_{uuid.uuid4().hex}"
    df.write.bucketBy(parts, key).option("path", f"{shared_dir(spark)}/{name}").format("parquet").saveAsTable(table_)
    out = spark.table(table_)
    spark.sql(f"DROP TABLE {table_}")  # its name alone: the files stay
    return out


#: Bits of a bitmap at most (16 MB), and for each row that it stands for.
MOST_BITS, BITS_PER_ROW = 1 << 27, 16
_PART = 1 << 15


def bitmap(rows: DataFrame, key: str) -> np.ndarray:
    """A bitmap, 16 MB at most whatever the rows, with the lower bits of every row's key (long) set; use it by in_bitmap().

    It tells most rows without a match before they are moved; what it lets pass is joined. Beyond some 10^8 rows it lets
    more and more pass, and never loses one.
    """
    bits = _PART
    many = rows.count()
    while bits < MOST_BITS and bits < many * BITS_PER_ROW:
        bits *= 2
    place = F.col(key).bitwiseAND(F.lit(bits - 1))
    parts = rows.groupBy(F.floor(place / _PART).cast("int").alias("part")).agg(F.bitmap_construct_agg((place % _PART).cast("long")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():
        out[r.part * (_PART // 8) : (r.part + 1) * (_PART // 8)] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be one of the bitmap's."""
    place = keys.astype(np.int64) & (8 * len(bits) - 1)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, doc_id and text, whatever else docs has."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"), "page_id")
