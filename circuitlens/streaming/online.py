"""Online operators as Structured Streaming jobs that pick up where their checkpoint left off."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from circuitlens.operators.outcomes import is_valid
from circuitlens.sources import shared


def read_stream(spark: SparkSession, path: str, like: DataFrame, files: int | None = None) -> DataFrame:
    """Files of a folder as a stream, ``files`` of them a batch."""
    reader = spark.readStream.schema(like.schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Drain what has come since the last run into a table."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def dedupe(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Valid results only, the first of each key; later ones are dropped by the keys' state."""
    return stream.where(is_valid(F.col("acf_min"), F.col("sim_time"))).dropDuplicates(keys)


def running_q(stream: DataFrame) -> DataFrame:
    """Visits, reward and rate of every state so far."""
    return stream.groupBy("state").agg(F.count("*").alias("visits"), F.sum("reward").alias("reward"), F.avg("reward").alias("q"))


def snapshot(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All totals after each batch, one folder a batch; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/snapshot={number:06d}")

    return totals.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def _folders(spark: SparkSession, path: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def timed_snapshots(totals: DataFrame, path: str, checkpoint: str, period: float, clock: Callable[[], float] = time.time, drain: bool = False) -> StreamingQuery:
    """All totals once a ``period`` of seconds: a folder ``snapshot=<periods since the start>`` each time that one has passed.

    The totals so far also stay in ``_latest=<batch>``, for the snapshot at the end. The
    start is the clock's time at the first batch; it is kept in the folder's names, as are the
    snapshots, so a restart goes on with the same periods and repeats
    none of them. Where several have passed between two batches, one snapshot is taken, of the last.
    ``drain`` stops when what has come is read; else batches come once a period. ``clock`` is for tests.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, now, names = batch.sparkSession, clock(), _folders(batch.sparkSession, path)
        batch.write.mode("overwrite").parquet(f"{path}/_latest={number:012d}")
        started = [float(n.partition("=")[2]) for n in names if n.startswith("_start=")]
        if not started:
            fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_start={now!r}")
            fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(fs_path)
        passed = int((now - (started[0] if started else now)) // period)
        done = max([0, *(int(n.partition("=")[2]) for n in names if n.startswith("snapshot="))])
        if passed > done:
            _publish(spark, f"{path}/_latest={number:012d}", path, passed)
        for name in names:
            if name.startswith("_latest=") and name < f"_latest={number:012d}":
                shared.delete(spark, f"{path}/{name}")

    started = totals.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    started = started.trigger(availableNow=True) if drain else started.trigger(processingTime=f"{period} seconds")
    return started.foreachBatch(write).start()


def _publish(spark: SparkSession, source: str, path: str, number: int) -> None:
    """A copy of ``source`` as a snapshot, complete from the moment that it has its name."""
    scratch = f"{path}/_new={number:06d}"
    spark.read.parquet(source).write.mode("overwrite").parquet(scratch)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    jvm_path(scratch).getFileSystem(spark._jsc.hadoopConfiguration()).rename(jvm_path(scratch), jvm_path(f"{path}/snapshot={number:06d}"))


def final_snapshot(spark: SparkSession, path: str) -> None:
    """What has come since the last snapshot of ``timed_snapshots``, as one more."""
    names = _folders(spark, path)
    latest = [n for n in names if n.startswith("_latest=")]
    if latest:
        _publish(spark, f"{path}/{latest[-1]}", path, 1 + max([0, *(int(n.partition("=")[2]) for n in names if n.startswith("snapshot="))]))
