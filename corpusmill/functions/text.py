"""Column functions over paths, file contents and chunk texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.schema import (
    CHUNK_MIN_CHARS,
    EXCLUDED_DIRS,
    HEADER_PREFIX,
    SNIPPET_CHARS,
    TARGET_EXTENSIONS,
)

WORD = r"[\p{L}\p{N}_]+"
NOT_WORD = r"[^\p{L}\p{N}_]+"


def normalize_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def extension(path: Column) -> Column:
    """Last suffix of the file name with its dot; '' for none or a dot-file."""
    return F.regexp_extract(path, r"[^/\\.][^/\\]*(\.[^/\\.]*)$", 1)


def language_of(path: Column) -> Column:
    """Language by extension, case-sensitive; null for other files."""
    ext = extension(path)
    out = F.lit(None).cast("string")
    for suffix, language in TARGET_EXTENSIONS.items():
        out = F.when(ext == suffix, language).otherwise(out)
    return out


def in_excluded_dir(relative_path: Column) -> Column:
    """True when a directory below the scan root has an excluded name."""
    parts = F.split(normalize_path(relative_path), "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return F.arrays_overlap(folders, F.array(*[F.lit(d) for d in EXCLUDED_DIRS]))


def decode_text(content: Column) -> Column:
    """Bytes to text: bad UTF-8 becomes U+FFFD, CRLF and CR become LF."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.regexp_replace(text, "\r\n?", "\n")


def with_header(path: Column, code: Column) -> Column:
    return F.concat(F.lit(HEADER_PREFIX), path, F.lit("\n"), code)


def chunk_id(text_hash: Column, start_line: Column, end_line: Column, node_type: Column) -> Column:
    """Reproducible row id, so a re-run writes the same rows."""
    return F.md5(F.concat_ws(
        "|", text_hash, start_line.cast("string"), end_line.cast("string"), node_type))


def short_path(path: Column) -> Column:
    parts = F.split(normalize_path(path), "/")
    tail = F.array_join(F.slice(parts, -3, 3), "/")
    return F.when(F.size(parts) >= 3, tail).otherwise(path)


def snippet(text: Column, chars: int = SNIPPET_CHARS) -> Column:
    return F.substring(F.translate(F.coalesce(text, F.lit("")), "\n", " "), 1, chars)


def or_default(col: Column, default: str) -> Column:
    """The value, or ``default`` for null and empty."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))


def words(text: Column) -> Column:
    """Lower-cased word tokens of the whole text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def spaced_words(text: Column) -> Column:
    """:func:`words` in one string, with one space for whatever stands between them."""
    return F.regexp_replace(F.lower(text), F.lit(NOT_WORD), F.lit(" "))


def first_tokens(tokens: Column, limit: int) -> Column:
    """The token cap of a model input."""
    return F.slice(tokens, 1, limit)


def is_big_enough(text: Column, min_chars: int = CHUNK_MIN_CHARS) -> Column:
    return F.length(text) >= min_chars


def like_contains(col: Column, needle: str, ignore_case: bool = False) -> Column:
    """Substring test; ``%`` and ``_`` in the needle are plain characters."""
    if ignore_case:
        return F.contains(F.lower(col), F.lit(needle.lower()))
    return F.contains(col, F.lit(needle))
