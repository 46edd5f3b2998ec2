"""Events as streams: dispatch after commit, an outbox for what a broker refuses, commands from events."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Sink = Callable[[DataFrame, int], None]


def after_commit(stream: DataFrame, commit: Sink, dispatch: Sink, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch is committed, then dispatched: nothing is published of a batch whose commit fails. A batch may come
    again after a failure, with the same number, by which sinks can tell it."""

    def both(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            commit(rows, number)
            dispatch(rows, number)
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def with_outbox(publish: Sink, outbox: str) -> Sink:
    """Publish a batch; what the broker refuses is kept in the outbox folder, by batch, for relay()."""

    def sink(batch: DataFrame, number: int) -> None:
        try:
            publish(batch, number)
        except Exception as e:  # noqa: BLE001 - whatever the broker raises
            batch.withColumn("reason", F.lit(str(e)[:200])).withColumn("attempts", F.lit(1)).write.mode("overwrite").parquet(f"{outbox}/batch={number}")

    return sink


def relay(spark: SparkSession, publish: Callable[[DataFrame], None], outbox: str) -> tuple[int, int]:
    """Publish the outbox's batches again, oldest first; (published, still pending).

    A batch that the broker takes is removed from the outbox, so that the next relay doesn't publish it again; one that it
    refuses stays, with one attempt more. Between publishing and removing a failure may publish a batch twice."""
    fs, folder, done, left = _files(spark, outbox)
    for path in folder:
        rows = spark.read.parquet(path)
        try:
            publish(rows)
        except Exception as e:  # noqa: BLE001
            rows.withColumns({"attempts": F.col("attempts") + 1, "reason": F.lit(str(e)[:200])}).write.mode("overwrite").parquet(f"{outbox}/_again")
            fs.delete(_path(spark, path), True)
            fs.rename(_path(spark, f"{outbox}/_again"), _path(spark, path))
            left += 1
        else:
            fs.delete(_path(spark, path), True)
            done += 1
    return done, left


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, outbox: str):
    """The file system, the folders of an outbox's batches by number, and two zeros."""
    root = _path(spark, outbox)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [str(s.getPath().getName()) for s in fs.listStatus(root)] if fs.exists(root) else []
    batches = sorted((n for n in names if n.startswith("batch=")), key=lambda n: int(n[6:]))
    return fs, [f"{outbox}/{n}" for n in batches], 0, 0


def with_failure_log(sink: Sink, log: str) -> Sink:
    """A sink whose failures are kept in the log folder (batch, error, at) before they are raised."""

    def logged(batch: DataFrame, number: int) -> None:
        try:
            sink(batch, number)
        except Exception as e:
            row = batch.sparkSession.createDataFrame([(number, f"{type(e).__name__}: {e}"[:500])], "batch long, error string")
            row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(log)
            raise

    return logged


def commands(events: DataFrame, kind: Column, fields: Mapping[str, Column]) -> DataFrame:
    """The commands that events of a kind give, one for each, their fields mapped one to one. Works on streams too."""
    return events.filter(kind).select(*[c.alias(n) for n, c in fields.items()])
