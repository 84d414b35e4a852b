"""Cut nodes (a declaration, or a whole document) into chunks.

Everything here is row-local: one narrow stage, no shuffle, no Python worker.
A node's lines are folded once; pieces leave the row only as finished texts, so
the generator never copies the node next to each of its pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.schema import CHUNK_COLUMNS, CHUNK_MAX_CHARS, CHUNK_MIN_CHARS

_BUFFER = "struct<pieces:array<struct<start:int,lines:int,code:string>>,first:int,lines:int,size:int,seen:int,code:string>"


def packed_pieces(code: Column, max_chars: int, min_chars: int) -> Column:
    """Greedy line packing: array of (start offset, line count, code).

    The buffer closes before the line that would bring it to ``max_chars``; a
    line that reaches it from an empty buffer is a piece of its own. Pieces
    under ``min_chars`` are dropped.
    """
    empty = F.struct(
        F.array().alias("pieces"), F.lit(0).alias("first"), F.lit(0).alias("lines"),
        F.lit(0).alias("size"), F.lit(0).alias("seen"), F.lit("").alias("code"),
    ).cast(_BUFFER)

    def state(pieces, first, lines, size, seen, text):
        return F.struct(
            pieces.alias("pieces"), first.alias("first"), lines.alias("lines"),
            size.alias("size"), seen.alias("seen"), text.alias("code"))

    def closed(buf: Column, first: Column, lines: Column, size: Column, text: Column) -> Column:
        piece = F.struct(first.alias("start"), lines.alias("lines"), text.alias("code"))
        keep = (size >= min_chars) & (size > 0)
        return F.when(keep, F.concat(buf["pieces"], F.array(piece))).otherwise(buf["pieces"])

    def add_line(buf: Column, line: Column) -> Column:
        none, one = F.lit(0), F.lit(1)
        nothing = buf["lines"] == 0
        after = buf["seen"] + 1
        alone = state(
            closed(buf, buf["seen"], one, F.length(line), line),
            after, none, none, after, F.lit(""))
        carried = state(
            closed(buf, buf["first"], buf["lines"], buf["size"], buf["code"]),
            buf["seen"], one, F.length(line), after, line)
        started = state(buf["pieces"], buf["seen"], one, F.length(line), after, line)
        grown = state(
            buf["pieces"], buf["first"], buf["lines"] + 1,
            buf["size"] + 1 + F.length(line), after,
            F.concat(buf["code"], F.lit("\n"), line))
        return (
            F.when(nothing & (F.length(line) >= max_chars), alone)
            .when(nothing, started)
            .when(buf["size"] + 1 + F.length(line) >= max_chars, carried)
            .otherwise(grown)
        )

    def finish(buf: Column) -> Column:
        rest = closed(buf, buf["first"], buf["lines"], buf["size"], buf["code"])
        return F.when(buf["lines"] > 0, rest).otherwise(buf["pieces"])

    return F.aggregate(F.split(code, "\n", -1), empty, add_line, finish)


def _line_count(code: Column) -> Column:
    return F.length(code) - F.length(F.replace(code, F.lit("\n"), F.lit(""))) + 1


def _explode_pieces(nodes: DataFrame, pieces: Column) -> DataFrame:
    cut = nodes.select(
        "filepath", "language", "node_type", "start_line",
        F.explode(pieces).alias("piece"))
    first = (F.col("start_line") + F.col("piece.start")).cast("int")
    return cut.select(
        "filepath", "language", "node_type",
        first.alias("start_line"),
        (first + F.col("piece.lines") - 1).cast("int").alias("end_line"),
        F.col("piece.code").alias("code"),
    )


def with_hash(pieces: DataFrame) -> DataFrame:
    """Prefix the header, hash the text, derive the id."""
    texts = pieces.select(
        tx.with_header(F.col("filepath"), F.col("code")).alias("text"),
        "filepath", "start_line", "end_line", "node_type", "language")
    hashed = texts.withColumn("text_hash", F.md5("text"))
    return hashed.withColumn("id", tx.chunk_id(
        F.col("text_hash"), F.col("start_line"), F.col("end_line"), F.col("node_type"),
    )).select(*CHUNK_COLUMNS)


def split_long(
    nodes: DataFrame,
    max_chars: int = CHUNK_MAX_CHARS,
    min_chars: int = CHUNK_MIN_CHARS,
) -> DataFrame:
    """Pack every node, whatever its size.

    ``nodes``: filepath, language, node_type, start_line, code (no header).
    """
    pieces = packed_pieces(F.col("code"), max_chars, min_chars)
    return with_hash(_explode_pieces(nodes, pieces))


def chunk_nodes(
    nodes: DataFrame,
    max_chars: int = CHUNK_MAX_CHARS,
    min_chars: int = CHUNK_MIN_CHARS,
) -> DataFrame:
    """Drop nodes under the lower bound, keep fitting ones, pack the others.

    Both bounds look at header plus code, while packing looks at the code alone.
    """
    code = F.col("code")
    size = F.length(tx.with_header(F.col("filepath"), code))
    whole = F.array(F.struct(
        F.lit(0).alias("start"), _line_count(code).cast("int").alias("lines"), code.alias("code")))
    pieces = (
        F.when(size > max_chars, packed_pieces(code, max_chars, min_chars))
        .when(size >= min_chars, whole)
    )
    return with_hash(_explode_pieces(nodes, pieces))


def document_nodes(files: DataFrame) -> DataFrame:
    """Each target file as one node."""
    known = files.where(F.col("language").isNotNull() & F.col("content").isNotNull())
    return known.select(
        tx.normalize_path(F.col("filepath")).alias("filepath"),
        "language",
        F.lit("document").alias("node_type"),
        F.lit(1).alias("start_line"),
        F.col("content").alias("code"),
    )


def chunk_documents(
    files: DataFrame,
    max_chars: int = CHUNK_MAX_CHARS,
    min_chars: int = CHUNK_MIN_CHARS,
) -> DataFrame:
    return chunk_nodes(document_nodes(files), max_chars, min_chars)
