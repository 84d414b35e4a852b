"""Build and refresh the index: dedup, insert-if-absent, delete, change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators.chunking import chunk_documents
from corpusmill.operators.embedding import Encoder, embed
from corpusmill.schema import CHUNK_COLUMNS, INDEX, INDEX_COLUMNS
from corpusmill.session import shared_dir


def empty_index(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], INDEX)


def with_defaults(chunks: DataFrame) -> DataFrame:
    """Missing metadata: '' for strings, 0 for line numbers."""
    texts = ["filepath", "node_type", "language"]
    return chunks.fillna("", subset=texts).fillna(0, subset=["start_line", "end_line"])


def dedup_chunks(chunks: DataFrame) -> DataFrame:
    """First chunk of each text_hash in (filepath, line, node type) order.

    Catalyst puts a partial group limit before the exchange, so a hash shared by
    a third of all rows leaves each map task as a single row.
    """
    order = Window.partitionBy("text_hash").orderBy(
        "filepath", "start_line", "end_line", "node_type", "id")
    numbered = chunks.withColumn("_nth", F.row_number().over(order))
    return numbered.where("_nth = 1").drop("_nth")


def stored_hashes(index: DataFrame) -> DataFrame:
    return index.where("text_hash <> ''").select("text_hash")


def new_chunks(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Deduplicated chunks whose hash is not stored.

    The anti join reuses the dedup's partitioning on text_hash; of the index it
    reads that one column.
    """
    return dedup_chunks(chunks).join(stored_hashes(index), "text_hash", "left_anti")


def upsert_chunks(index: DataFrame, chunks: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """Index after inserting the absent chunks; only those are embedded.

    Chunks that already carry a ``vector`` keep it. The check against all stored
    hashes shuffles that column of the whole index; to take in edited files use
    :func:`refresh_delta`, which needs the rows of those files only.
    """
    fresh = with_defaults(new_chunks(index, chunks))
    if "vector" not in fresh.columns:
        fresh = embed(fresh, encoder)
    return index.select(*INDEX_COLUMNS).unionByName(fresh.select(*INDEX_COLUMNS))


def lay_out(rows: DataFrame, shards: int) -> DataFrame:
    """Rows by language and id shard, the way a saved index is partitioned.

    Rebalancing on these columns lets AQE split a language that holds most rows
    and join small shards. Laid out before they are embedded, rows reach the
    encoder in even partitions and their vectors are never shuffled.
    """
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    return rows.withColumn("shard", shard).hint("rebalance", F.col("language"), F.col("shard"))


def _embedded(chunks: DataFrame, encoder: Encoder | None, shards: int | None) -> DataFrame:
    rows = with_defaults(chunks)
    if shards is None:
        return embed(rows, encoder).select(*INDEX_COLUMNS)
    return embed(lay_out(rows, shards), encoder).select(*INDEX_COLUMNS, "shard")


def build_index(
    files: DataFrame,
    encoder: Encoder | None = None,
    append_to: DataFrame | None = None,
    chunker=chunk_documents,
    shards: int | None = None,
) -> DataFrame:
    """Chunk, dedup, embed. ``append_to`` keeps the rows of an existing index.

    With ``shards`` the rows come laid out for saving.
    """
    chunks = chunker(files)
    if append_to is not None:
        return upsert_chunks(append_to, chunks, encoder)
    return _embedded(dedup_chunks(chunks), encoder, shards)


def build_summary(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files and chunks seen, chunks inserted."""
    seen = chunks.select("filepath", "text_hash")
    # One row per hash before the join: copies are combined map-side and counted.
    per_hash = seen.groupBy("text_hash").agg(F.count("*").alias("copies"))
    absent = per_hash.join(stored_hashes(index), "text_hash", "left_anti")
    inserted = absent.agg(F.count("*").alias("upserted"))
    totals = seen.agg(
        F.count_distinct("filepath").alias("files"), F.count("*").alias("chunks"))
    # Two one-row results side by side; the subquery keeps it a single job graph.
    return totals.withColumn("upserted", inserted.scalar())


def delete_by_filepath(index: DataFrame, paths: DataFrame) -> DataFrame:
    """Index without the rows of exactly these paths."""
    return index.join(paths.select("filepath"), "filepath", "left_anti").select(*index.columns)


def deleted_count(index: DataFrame, paths: DataFrame) -> DataFrame:
    hit = index.select("filepath").join(paths.select("filepath"), "filepath", "left_semi")
    return hit.agg(F.count("*").alias("deleted"))


def changed_files(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files with at least one chunk hash that is not stored for them."""
    keys = ["filepath", "text_hash"]
    unseen = chunks.select(*keys).join(index.select(*keys), keys, "left_anti")
    return unseen.select("filepath").distinct()


def differing_files(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files whose stored rows and new chunks differ in any way.

    Either side may lack the file. One aggregation over both sides, no join:
    a row id seen on one side only marks its file.
    """
    stored = index.select("filepath", "id", F.lit(0).alias("side"))
    current = chunks.select("filepath", "id", F.lit(1).alias("side"))
    sides = stored.unionByName(current).groupBy("filepath", "id").agg(
        F.min("side").alias("low"), F.max("side").alias("high"))
    return sides.where("low = high").select("filepath").distinct()


def refresh_delta(
    index: DataFrame,
    chunks: DataFrame,
    encoder: Encoder | None = None,
    mode: str = "compat",
    shards: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows to add, paths to remove first) that bring the index up to date.

    ``compat`` replaces a file only when it has a new hash; files that vanished,
    or only lost chunks, keep their rows. ``strict`` replaces every file that
    differs, so the result equals a fresh build. A chunk text starts with its
    path, hence hashes of different files never meet and the changed files'
    chunks need no check against the rows of other files.
    """
    if mode not in ("compat", "strict"):
        raise ValueError(f"mode must be 'compat' or 'strict', not {mode!r}")
    fresh = dedup_chunks(chunks)
    find = changed_files if mode == "compat" else differing_files
    changed = find(index, fresh)
    added = fresh.join(changed, "filepath", "left_semi").select(*CHUNK_COLUMNS)
    return _embedded(added, encoder, shards), changed


def refresh_index(
    index: DataFrame,
    files: DataFrame,
    encoder: Encoder | None = None,
    mode: str = "compat",
    chunker=chunk_documents,
) -> DataFrame:
    """Whole index after a refresh; snapshots write just the delta instead.

    Not lazy: the new chunks are written to the shared folder, so that files are read and
    chunked once, for the comparison and for the rows that come in. Of a stored index
    the comparison shuffles two narrow columns; texts and vectors stay where they are
    unless the replaced paths are too many for Spark to broadcast.
    """
    spark = index.sparkSession
    path = shared_dir(spark, "refresh-chunks")
    chunks = chunker(files)
    chunks.write.parquet(path)
    added, changed = refresh_delta(index, spark.read.schema(chunks.schema).parquet(path), encoder, mode)
    kept = delete_by_filepath(index, changed)
    return kept.select(*INDEX_COLUMNS).unionByName(added)


def refresh_summary(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files replaced, their chunks, and chunks inserted for them."""
    changed = changed_files(index, chunks)
    touched = chunks.select("filepath", "text_hash").join(changed, "filepath", "left_semi")
    return touched.agg(
        F.count_distinct("filepath").alias("files_updated"),
        F.count("*").alias("chunks"),
        F.count_distinct("text_hash").alias("upserted"))
