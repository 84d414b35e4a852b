"""Shared-folder tables and id helpers of the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.session import shared_dir


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, outlives executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no result, finished or lazy, reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def without(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows whose id is not among ``ids``; rows with a null id stay."""
    return docs.join(ids.select(column), column, "left_anti").select(docs.columns)


#: Rows that a task works on at a time.
SLICE_ROWS = 512


def _give_back() -> None:
    """Return freed memory to the system: Python workers live on into later stages, idle or not."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library can
        pass


def lean(task: Callable, rows: int | None = SLICE_ROWS) -> Callable:
    """A mapInArrow task over slices of the batches (whole ones without ``rows``) that leaves no memory behind."""

    def run(batches):
        slices = batches if rows is None else (b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows))
        try:
            yield from task(slices)
        finally:
            _give_back()

    return run


def lean_group(task: Callable) -> Callable:
    """The same for a function of one or two grouped tables."""

    def one(table: pa.Table) -> pa.Table:
        try:
            return task(table)
        finally:
            _give_back()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return task(left, right)
        finally:
            _give_back()

    return two if task.__code__.co_argcount == 2 else one
