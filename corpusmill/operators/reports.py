"""Counts over the index: totals, breakdowns, per-file rows, snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.schema import FILE_LIST_N, HOVER_CHARS, SNIPPET_CHARS, TOP_NODE_TYPES_N


def index_status(index: DataFrame, name: str = "codebase", location: str = "") -> DataFrame:
    return index.agg(F.count("*").alias("total_chunks")).select(
        F.lit(name).alias("collection_name"), "total_chunks",
        F.lit(location).alias("location"))


def index_totals(index: DataFrame) -> DataFrame:
    path = F.coalesce("filepath", F.lit(""))
    return index.agg(
        F.count("*").alias("total_chunks"), F.count_distinct(path).alias("total_files"))


def index_stats(index: DataFrame) -> DataFrame:
    """Chunks by language, by node type and in total, in one pass."""
    named = index.select(
        tx.or_default(F.col("language"), "unknown").alias("language"),
        tx.or_default(F.col("node_type"), "unknown").alias("node_type"))
    counted = named.groupingSets(
        [["language"], ["node_type"], []], "language", "node_type",
    ).agg(F.count("*").alias("chunks"), F.grouping_id().alias("level"))
    # grouping_id has bit 2 set when language is rolled up, bit 1 for node_type.
    dimension = (
        F.when(F.col("level") == 1, "language")
        .when(F.col("level") == 2, "node_type").otherwise("total"))
    return counted.select(
        dimension.alias("dimension"),
        F.coalesce("language", "node_type", F.lit("all")).alias("value"), "chunks")


def top_node_types(index: DataFrame, n: int = TOP_NODE_TYPES_N) -> DataFrame:
    kinds = index.groupBy(tx.or_default(F.col("node_type"), "unknown").alias("node_type"))
    counted = kinds.agg(F.count("*").alias("chunks"))
    return counted.orderBy(F.desc("chunks"), F.asc("node_type")).limit(n)


def languages_by_size(index: DataFrame) -> DataFrame:
    kinds = index.groupBy(tx.or_default(F.col("language"), "unknown").alias("language"))
    return kinds.agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), F.asc("language"))


def file_stats(index: DataFrame) -> DataFrame:
    """Chunks per file with its language and the short form of its path."""
    grouped = index.groupBy("filepath").agg(
        F.min(F.coalesce("language", F.lit(""))).alias("language"),
        F.count("*").alias("chunk_count"))
    return grouped.withColumn("short_filepath", tx.short_path(F.col("filepath")))


def file_stats_top(
    files: DataFrame, ascending: bool = False, n: int = FILE_LIST_N,
) -> DataFrame:
    """First n files by chunk count; ties by path."""
    count = F.asc("chunk_count") if ascending else F.desc("chunk_count")
    return files.orderBy(count, F.asc("filepath")).limit(n)


def file_filter(files: DataFrame, needle: str) -> DataFrame:
    """Files whose path contains the text in any case; '' keeps all."""
    if not needle:
        return files
    return files.where(tx.like_contains(F.col("filepath"), needle, ignore_case=True))


def snippets(index: DataFrame) -> DataFrame:
    return index.select(
        "id", tx.short_path(F.col("filepath")).alias("short_filepath"), "start_line",
        tx.snippet(F.col("text"), SNIPPET_CHARS).alias("snippet"),
        tx.snippet(F.col("text"), HOVER_CHARS).alias("hover"))
