"""Keep a stored index up to date from a stream of edit events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.functions import text as tx
from corpusmill.functions.keys import MAX_PUSHED_KEYS, among
from corpusmill.operators.chunking import chunk_documents
from corpusmill.operators.embedding import Encoder
from corpusmill.operators.maintenance import refresh_delta
from corpusmill.session import remove_dir, shared_dir
from corpusmill.sources.events import edited_paths, stream_events
from corpusmill.sources.files import read_files
from corpusmill.sources.snapshots import append_delta, read_index

MAX_BROADCAST_PATHS = 50_000


def stored_rows(index: DataFrame, paths: DataFrame) -> DataFrame:
    """Index rows of distinct paths; counts the paths.

    Up to ``MAX_PUSHED_KEYS`` paths are a filter of the scan: parquet skips the row groups
    of a saved index whose Bloom filter has none of them. More are broadcast, and beyond
    ``MAX_BROADCAST_PATHS`` Spark sizes the join itself.
    """
    n = paths.count()
    if n <= MAX_PUSHED_KEYS:
        return index.where(among("filepath", [r["filepath"] for r in paths.collect()]))
    return index.join(F.broadcast(paths) if n <= MAX_BROADCAST_PATHS else paths, "filepath", "left_semi")


def refresh_paths(
    index: DataFrame,
    paths: DataFrame,
    loader: Callable[[DataFrame], DataFrame] = read_files,
    encoder: Encoder | None = None,
    mode: str = "compat",
    chunker=chunk_documents,
    shards: int = 16,
    work: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Delta for some files: reads these files and their index rows only.

    Paths and chunks are written to the folder ``work`` (a new one in the shared folder),
    so that files are read once and both parts of the delta see the same contents.
    Both read that folder, which may go when they have been used.
    """
    spark = index.sparkSession
    work = work or shared_dir(spark, "refresh")
    named = _written(paths.select("filepath").distinct(), f"{work}/paths")
    chunks = _written(chunker(loader(named)), f"{work}/chunks")
    stored = stored_rows(index, named.select(tx.normalize_path(F.col("filepath")).alias("filepath")).distinct())
    return refresh_delta(stored, chunks, encoder, mode, shards)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stream_refresh(
    spark: SparkSession,
    events_dir: str,
    index_path: str,
    checkpoint: str,
    loader: Callable[[DataFrame], DataFrame] = read_files,
    encoder: Encoder | None = None,
    mode: str = "compat",
    chunker=chunk_documents,
    name: str = "refresh",
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Refresh the index with the files each micro-batch of events touched.

    Only those files are read again, not the whole project. Takes all events
    present, in batches of ``files_per_batch`` event files if given, and stops.

    A batch that is replayed after a failure carries the same token and is committed
    once. The token holds the stream's own id, which lives in its checkpoint: another
    stream, or one that starts again with a new checkpoint, has other tokens, so
    none takes another's batches for its own.
    """

    def refresh(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if stream is None:
            raise RuntimeError("the batch does not name its stream")
        session = batch.sparkSession
        work = shared_dir(session, "micro-batch")
        try:
            # Written once: a batch is otherwise evaluated again by every action.
            paths = _written(edited_paths(batch).select("filepath").distinct(), f"{work}/events")
            if paths.isEmpty():
                return
            index = read_index(session, index_path)
            added, removed = refresh_paths(
                index, paths, loader, encoder, mode, chunker, work=f"{work}/delta")
            append_delta(added, removed, index_path, token=f"{name}-{stream}-{batch_id}")
        finally:
            remove_dir(session, work)

    return (
        stream_events(spark, events_dir, files_per_batch).writeStream.foreachBatch(refresh)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start())
