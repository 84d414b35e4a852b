"""Corpus files as a DataFrame: from a table, or from a mounted directory tree."""

from __future__ import annotations

import logging
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.schema import EXCLUDED_DIRS
from corpusmill.session import ensure_checkpoint_dir

_ENTRY = "path string, relative string, is_dir boolean"
_BATCH = 1024
#: Paths that one task lists or reads, beyond one task per core.
_PATHS_PER_TASK = 500
_LOG = logging.getLogger(__name__)


def scan_files(files: DataFrame, root: str = "") -> DataFrame:
    """Target files of a (filepath, ...) table, with their language.

    Drops unknown extensions and anything in an excluded directory below
    ``root``; the root's own name is not looked at. Row-local, no shuffle.
    """
    path = tx.normalize_path(F.col("filepath"))
    prefix = root.replace("\\", "/").rstrip("/")
    below = path if not prefix else F.when(
        path.startswith(prefix + "/"), F.substr(path, F.lit(len(prefix) + 2)))
    kept = files.where(below.isNotNull() & ~tx.in_excluded_dir(below))
    known = kept.withColumn("language", tx.language_of(F.col("filepath"))).where(
        F.col("language").isNotNull())
    return known.withColumn("filepath", path)


def _list_dirs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pack(rows):
        paths, relatives, dirs = zip(*rows, strict=True)
        return pa.RecordBatch.from_pydict({
            "path": pa.array(paths, pa.string()),
            "relative": pa.array(relatives, pa.string()),
            "is_dir": pa.array(dirs, pa.bool_())})

    rows = []
    for batch in batches:
        for path, relative in zip(
                batch["path"].to_pylist(), batch["relative"].to_pylist(), strict=True):
            try:
                entries = os.scandir(path)
            except OSError:
                continue
            with entries:
                for entry in entries:
                    # Names that are not valid UTF-8 cannot be a string column.
                    name = entry.name.encode("utf-8", "surrogateescape")
                    if name.decode("utf-8", "replace") != entry.name:
                        _LOG.warning("name is not UTF-8, skipped: %r in %s", name, path)
                        continue
                    is_dir = entry.is_dir()
                    if is_dir and (entry.name in EXCLUDED_DIRS or entry.is_symlink()):
                        continue
                    below = f"{relative}/{entry.name}" if relative else entry.name
                    rows.append((entry.path, below, is_dir))
                    if len(rows) >= _BATCH:
                        yield pack(rows)
                        rows = []
    if rows:
        yield pack(rows)


def _spread(paths: DataFrame, column: str) -> DataFrame:
    """Deal paths out evenly: rows are tiny, so AQE would merge them into one task.

    The number of partitions follows the number of paths, at least one per core.
    """
    cores = paths.sparkSession.sparkContext.defaultParallelism
    count = paths.count()
    return paths.repartition(max(1, min(count, max(cores, count // _PATHS_PER_TASK))), column)


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """Paths of the target files below ``root`` on a mount all workers share.

    Walks level by level, each level one job over its directories, because
    Spark's own listing hides names that start with '_' or '.'. The driver sees
    only whether a next level exists. Excluded directories are never opened.
    """
    if not os.path.isdir(root):
        raise FileNotFoundError(f"Directory not found: {root}")
    ensure_checkpoint_dir(spark)
    level = spark.createDataFrame([(root, "")], "path string, relative string")
    found = None
    while True:
        entries = _spread(level, "path").mapInArrow(_list_dirs, _ENTRY).checkpoint()
        files = entries.where(~F.col("is_dir")).select("path")
        found = files if found is None else found.unionByName(files)
        level = entries.where("is_dir").select("path", "relative")
        if level.isEmpty():
            break
    return found.where(tx.language_of(F.col("path")).isNotNull()).withColumnRenamed(
        "path", "filepath")


def _read_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch["filepath"].to_pylist():
            try:
                with open(path, "rb") as handle:
                    content = handle.read()
            except OSError:
                continue
            yield pa.RecordBatch.from_pydict({
                "filepath": pa.array([path], pa.string()),
                "content": pa.array([content], pa.binary())})


def read_files(paths: DataFrame) -> DataFrame:
    """Contents of the given paths; unknown extensions and unreadable files drop out.

    Counts the paths, to spread the reading over as many tasks as they need.
    """
    known = paths.where(tx.language_of(F.col("filepath")).isNotNull()).select("filepath")
    raw = _spread(known, "filepath").mapInArrow(
        _read_bytes, "filepath string, content binary")
    return read_normalize(raw)


def read_normalize(raw: DataFrame) -> DataFrame:
    """Decode ``content``; with a ``filepath``, add language and normalise it."""
    text = raw.withColumn("content", tx.decode_text(F.col("content")))
    if "filepath" not in raw.columns:
        return text
    return text.select(
        tx.normalize_path(F.col("filepath")).alias("filepath"),
        tx.language_of(F.col("filepath")).alias("language"), "content")


def load_tree(spark: SparkSession, root: str) -> DataFrame:
    """Files table of a directory tree."""
    return read_files(list_tree(spark, root))
