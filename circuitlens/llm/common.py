"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from circuitlens.sources import shared


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the corpus, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    return shared.cut(df)


class Rounds:
    """The table that each round of an iteration hands to the next, written in the shared folder.

    Unlike a checkpoint, a table read back has its true size, where size
    estimates that square in every round would soon have millions of digits.
    The table before the last is deleted, and ``last`` as well by ``close``.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.written = spark, shared.scratch(spark, "rounds"), 0

    def __call__(self, df: DataFrame) -> DataFrame:
        path, schema = f"{self.folder}/{self.written}", df.schema
        df.write.parquet(path)
        if self.written > 1:
            shared.delete(self.spark, f"{self.folder}/{self.written - 2}")
        self.written += 1
        return self.spark.read.schema(schema).parquet(path)

    def close(self, df: DataFrame) -> DataFrame:
        """``df`` as a checkpoint, without the tables of the rounds."""
        kept = checkpointed(df)
        shared.delete(self.spark, self.folder)
        return kept


def text_blocks(batches: Iterable[pa.RecordBatch], limit: int = 4_000_000, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about ``limit`` bytes of text, one row at least.

    Bounds what a task holds at once however long the texts of a batch are;
    rows are never dropped or cut.
    """
    for batch in batches:
        sizes = [len(v.as_buffer()) if v.is_valid else 0 for v in batch.column(column).cast(pa.large_string())]
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows with equal ``keys``, of which no key is null, from batches sorted by them."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
        if not table.num_rows:
            continue
        changed = np.zeros(table.num_rows, bool)
        for key in keys:
            values = table.column(key).to_numpy()
            changed[1:] |= values[1:] != values[:-1]
        starts = [0, *np.flatnonzero(changed).tolist()]
        for a, b in zip(starts, starts[1:]):
            yield table.slice(a, b - a)
        held = table.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held
