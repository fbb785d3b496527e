"""What the operators need from the cluster: written intermediate tables, shipped code, and joins that leave texts in place."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell.sources.shared import new_path, python_ready, remove, settle

__all__ = ["by_bytes", "materialize", "meet", "python_ready", "read", "sent", "small", "small_transfers", "temporary", "without"]

#: Rows worked on at a time in a Python worker. Spark bounds a batch by bytes; this bounds what is made from it.
BATCH_ROWS = 256
#: Keys of rows to leave out that are broadcast at most (about 30 MB); beyond that the rows meet them in a shuffle.
MOST_BROADCAST = 250_000
#: Keys that are met by a broadcast because many rows have them, and the rows that a key needs for it.
HOT_KEYS, LEAST_HOT = 4096, 1000


#: Tables written inside the innermost temporary(), with their folders.
_WRITTEN: ContextVar[list[tuple[DataFrame, str]] | None] = ContextVar("written", default=None)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df, written to the shared folder and read back."""
    path = path or new_path(df.sparkSession, name)
    written = settle(df, name, path)
    if (tables := _WRITTEN.get()) is not None:
        tables.append((written, path))
    return written


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are written inside are deleted at the end, but for those given to what this yields."""
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    outer = _WRITTEN.set([])
    try:
        yield keep
    finally:
        inside = _WRITTEN.get()
        _WRITTEN.reset(outer)
        for table, path in inside:
            if not any(table is k for k in kept):
                remove(spark, path)
            elif (around := _WRITTEN.get()) is not None:
                around.append((table, path))


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of BATCH_ROWS at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def by_bytes(batches: Iterator[pa.RecordBatch], text: str | int, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many bytes of a text column, or of one row where that alone has more."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


@contextmanager
def small_transfers(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_ROWS between JVM and Python for what is written inside; the session's own setting returns."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sent(table: DataFrame, name: str) -> DataFrame:
    """The table, written, to be joined by a broadcast where its count allows that and by a shuffle where not."""
    written = materialize(table, name)
    return F.broadcast(written) if written.count() <= MOST_BROADCAST else written


def without(rows: DataFrame, gone: DataFrame, on: Column) -> DataFrame:
    """The rows that no row of gone, a written table, matches. The broadcast of gone is bounded by its count. Columns in on
    are taken from the two tables, rows["x"] and gone["y"], so equal names do not clash."""
    return rows.join(F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone, on, "left_anti")


def meet(rows: DataFrame, table: DataFrame, key: str, n: str, n_rows: int) -> DataFrame:
    """rows joined with a written table that has one row for each key and, in column n, how many of the n_rows rows have it.
    Keys with more than one row in HOT_KEYS are broadcast, HOT_KEYS of them at most, so their rows stay where they are;
    the others meet in a shuffle, in which no key has more than that share."""
    least = max(n_rows // HOT_KEYS, LEAST_HOT) + 1
    hot = F.broadcast(table.where(F.col(n) >= least).drop(n))
    settled = rows.join(hot, key)
    others = rows.join(F.broadcast(table.where(F.col(n) >= least).select(key)), key, "left_anti").join(table.where(F.col(n) < least).drop(n), key)
    return settled.unionByName(others)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
