"""Table schemas and the fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Chunk size bounds, in characters.
CHUNK_MIN_CHARS = 30
CHUNK_MAX_CHARS = 1500

# Vector size, model batch size, candidate and result counts.
EMBED_DIM = 1024
EMBED_BATCH_ROWS = 64
CANDIDATE_K = 40
RESULT_N = 8

# Token caps a plugged-in model applies to a document and to a pair.
DOCUMENT_MAX_TOKENS = 512
PAIR_MAX_TOKENS = 1024

# Instruction prefixes of the two encoder inputs.
PASSAGE_PREFIX = "passage: "
QUERY_PREFIX = "query: "

# First line of every chunk text.
HEADER_PREFIX = "// File: "

# File extension to language.
TARGET_EXTENSIONS = {
    ".ts": "typescript",
    ".tsx": "typescript",
    ".go": "go",
}

# Directory names whose whole subtree is skipped.
EXCLUDED_DIRS = [
    ".git",
    ".claude",
    ".worktrees",
    "node_modules",
    "dist",
    "build",
    ".next",
    "vendor",
    "__pycache__",
    "coverage",
    ".turbo",
]

# Result sizes of the listing reports.
PATH_SEARCH_N = 20
FILE_LIST_N = 1000
TOP_NODE_TYPES_N = 10
SNIPPET_CHARS = 120
HOVER_CHARS = 80
MAP_MIN_ROWS = 10

FILES = T.StructType([
    T.StructField("filepath", T.StringType(), False),
    T.StructField("language", T.StringType()),
    T.StructField("content", T.StringType()),
])

INDEX = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("vector", T.ArrayType(T.FloatType(), False)),
    T.StructField("text", T.StringType()),
    T.StructField("filepath", T.StringType()),
    T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("node_type", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("text_hash", T.StringType()),
])

CHUNK_COLUMNS = [
    "id", "text", "filepath", "start_line", "end_line",
    "node_type", "language", "text_hash",
]
INDEX_COLUMNS = INDEX.fieldNames()
ROW_COLUMNS = [
    "text", "filepath", "start_line", "end_line",
    "node_type", "language", "text_hash",
]

EDIT_EVENT = T.StructType([
    T.StructField("tool_name", T.StringType()),
    T.StructField("tool_input", T.StructType([
        T.StructField("file_path", T.StringType()),
        T.StructField("edits", T.ArrayType(T.StructType([
            T.StructField("file_path", T.StringType()),
        ]))),
    ])),
])
