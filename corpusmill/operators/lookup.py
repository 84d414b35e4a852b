"""Path lookups over the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.schema import PATH_SEARCH_N, ROW_COLUMNS

_ORDER = ["filepath", "start_line", "end_line", "text_hash"]


def project_scan(index: DataFrame, *columns: str) -> DataFrame:
    """Scan of some columns, without a row cap."""
    return index.select(*columns)


def _first_rows(rows: DataFrame, n: int) -> DataFrame:
    if n < 1:
        raise ValueError("n must be at least 1")
    return rows.select(*ROW_COLUMNS).orderBy(*_ORDER).limit(n)


def path_search(index: DataFrame, pattern: str, n: int = PATH_SEARCH_N) -> DataFrame:
    """First n rows whose path contains ``pattern``, case-sensitive."""
    return _first_rows(index.where(tx.like_contains(F.col("filepath"), pattern)), n)


def path_like(index: DataFrame, pattern: str, n: int = PATH_SEARCH_N) -> DataFrame:
    """First n rows whose path contains a match of ``pattern``.

    Here ``%`` and ``_`` are wildcards.
    """
    return _first_rows(index.where(F.col("filepath").like(f"%{pattern}%")), n)


def file_chunks(index: DataFrame, filepath: str, partial: bool = False) -> DataFrame:
    """All rows of a file; with ``partial``, of every path containing the text."""
    wanted = filepath.replace("\\", "/")
    path = F.col("filepath")
    hit = tx.like_contains(path, wanted) if partial else path == F.lit(wanted)
    return index.where(hit).select(*ROW_COLUMNS)
