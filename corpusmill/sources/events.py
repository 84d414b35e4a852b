"""Edit events: JSON objects naming the files a tool touched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.schema import EDIT_EVENT


def stream_events(
    spark: SparkSession, events_dir: str, files_per_batch: int | None = None,
) -> DataFrame:
    """Stream of JSON-lines files; a malformed line becomes a row of nulls."""
    reader = spark.readStream.schema(EDIT_EVENT).option("mode", "PERMISSIVE")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(events_dir)


def parse_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """Events of a text column; malformed text becomes a row of nulls."""
    parsed = raw.select(F.from_json(F.col(column), EDIT_EVENT).alias("event"))
    return parsed.select("event.tool_name", "event.tool_input")


def edited_paths(events: DataFrame) -> DataFrame:
    """Touched source files: ``file_path`` if given, else those of ``edits``.

    The extension test ignores case. Works on streams as on tables.
    """
    single = F.col("tool_input.file_path")
    many = F.col("tool_input.edits.file_path")
    touched = events.select(
        "tool_name",
        F.explode(F.when(single.isNotNull(), F.array(single)).otherwise(many)).alias("filepath"))
    return touched.where(F.col("filepath").rlike(r"(?i)[^/]\.(ts|tsx|go)$"))
