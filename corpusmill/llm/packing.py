"""Packing documents into token sequences along a space-filling curve.

A document's tokens are hashed into ``BUCKETS`` classes; the damped counts, scaled to unit
length, are projected by fixed random signs to ``DIMS`` numbers. Mean and deviation of
each number over all documents lay a grid of equal shares over it, and the place of the
document's cell on the Hilbert curve is its key. The tokens are sorted by ranges of keys;
each range is filled into sequences in that order, so that neighbours on the curve share
a sequence. Documents are cut where a sequence is full, so only the end of a range is not:
it is laid out in sequences whose lengths are powers of two, which need no padding.

Tokens travel as 16-bit numbers (32-bit for larger vocabularies): they are made once,
written to the shared folder and shuffled once. A range is a sorted stream; a task holds
one Arrow batch and the sequence it fills.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import pairwise

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import hashing as hs
from corpusmill.llm.tables import written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LENGTH = 2048
END = 1
BUCKETS, DIMS, BITS = 1024, 4, 10
#: Fixed-point unit of the projections: their sums are exact and the same in every run.
UNIT = 1 << 12
#: Bytes of tokens in a range, about.
RANGE_BYTES = 32 << 20
#: Runs of white space that the faster library cannot take.
_RUN = re.compile(r"\s{20000}")


def _byte_letters() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(0x100) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Token ids of texts by a byte-level BPE file of ``tokenizers``.

    Its merges are applied by ``tiktoken``, which takes a quarter of the time for the same
    ids: the ids of such a file rise with the order of the merges, which is checked here.
    Texts with runs of white space that overflow that library go through ``tokenizers``.
    """

    def __init__(self, vocabulary: str):
        self.vocabulary = vocabulary
        model = json.loads(vocabulary)["model"]
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if any(a >= b for a, b in pairwise(made)):
            raise ValueError("the ids of the vocabulary do not follow its merges")
        letters = _byte_letters()
        last = max([*made, 0xFF])
        ranks = {bytes(map(letters.__getitem__, token)): k for token, k in model["vocab"].items() if k <= last}
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(model["vocab"].values()) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")

    @cached_property
    def slow(self) -> Tokenizer:
        tokenizer = Tokenizer.from_str(self.vocabulary)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        return tokenizer

    def encode(self, text: str) -> np.ndarray:
        if len(text) >= 20_000 and _RUN.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, self.kind)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(self.kind)


def signs() -> np.ndarray:
    """Fixed random signs, a row per class."""
    cells = hs.mix(np.arange(1, BUCKETS * DIMS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.where(cells & np.uint64(1 << 40), 1.0, -1.0).reshape(BUCKETS, DIMS)


def classes(tokens: int) -> np.ndarray:
    """The class of every token id."""
    return (hs.mix(np.arange(1, tokens + 1, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


def projected(documents: list[np.ndarray], table: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """DIMS fixed-point numbers for each document's ids."""
    out = np.zeros((len(documents), DIMS), np.int64)
    for low in range(0, len(documents), 256):
        some = documents[low:low + 256]
        owner = np.repeat(np.arange(len(some)), [len(d) for d in some])
        counts = np.bincount(owner * BUCKETS + table[np.concatenate(some)], minlength=len(some) * BUCKETS).reshape(len(some), BUCKETS)
        damped = np.log1p(counts)
        damped /= np.sqrt((damped * damped).sum(axis=1, keepdims=True))
        out[low:low + 256] = np.rint(damped @ matrix * UNIT)
    return out


def cells(numbers: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """Grid cells of projections: each coordinate's axis is cut so that a bell curve fills cells evenly."""
    z = (numbers - mean) / np.where(deviation > 0, deviation, 1.0)
    share = 1 / (1 + np.exp(-1.702 * np.clip(z, -30, 30)))
    return np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of points with coordinates of ``bits`` bits (rows x dimensions).

    From the highest bit down, the sub-cube's turns are undone: a set bit of a coordinate
    mirrors the first axis below that bit, a clear one swaps it with the first. The Gray
    code of the bits that remain, read across dimensions, counts along the curve.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for axis in range(dims):
            turned = (x[axis] >> bit & 1).astype(bool)
            swap = np.where(turned, 0, (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(turned, below, swap)
            x[axis] ^= swap
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    odd = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        odd ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= odd
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in range(dims):
            key = key << 1 | (x[axis] >> bit & 1)
    return key


Piece = tuple[object, int, np.ndarray, int]  # document, start, ids, tokens of the document


def fill(documents: Iterable[tuple[object, np.ndarray]], length: int) -> Iterator[list[Piece]]:
    """Sequences of exactly ``length`` ids along the stream, then its end in powers of two, longest first."""
    now: list[Piece] = []
    free = length
    for doc, ids in documents:
        at = 0
        while at < len(ids):
            part = ids[at:at + free]
            now.append((doc, at, part, len(ids)))
            at += len(part)
            free -= len(part)
            if not free:
                yield now
                now, free = [], length
    rest = length - free
    for bit in reversed(range(rest.bit_length())):
        if not rest >> bit & 1:
            continue
        free, sequence = 1 << bit, []
        while free:
            doc, start, ids, tokens = now.pop(0)
            sequence.append((doc, start, ids[:free], tokens))
            if len(ids) > free:
                now.insert(0, (doc, start + free, ids[free:], tokens))
            free -= min(free, len(ids))
        yield sequence


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """row, doc_id, ids (bytes), tokens, c0 to c3: every document's tokens with the end mark, and its projections.

    ``row`` depends on how the table is read: write the result before using it twice.
    """
    data = _read(vocabulary)

    def task(batches):
        encoder = Encoder(data)
        end = np.array([END], encoder.kind)
        table, matrix = classes(encoder.size), signs()
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                piece = batch.slice(low, 512)
                ids = [np.append(encoder.encode(t.as_py() or ""), end) for t in piece.column(2)]
                numbers = projected(ids, table, matrix)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array(list(map(len, ids)), pa.int64()),
                     *(pa.array(numbers[:, k]) for k in range(DIMS))],
                    names=["row", "doc_id", "ids", "tokens", *(f"c{k}" for k in range(DIMS))])

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        task, "row long, doc_id long, ids binary, tokens long, " + ", ".join(f"c{k} long" for k in range(DIMS)))


def measured(table: DataFrame) -> dict:
    """Tokens of all documents, and mean (m) and mean square (q) of each projection; sums are exact."""

    def mean(column):
        return (F.sum(column.cast("decimal(38,0)")) / F.count("*")).cast("double")

    return table.agg(
        F.sum("tokens").alias("tokens"),
        *(mean(F.col(f"c{k}")).alias(f"m{k}") for k in range(DIMS)),
        *(mean(F.col(f"c{k}") * F.col(f"c{k}")).alias(f"q{k}") for k in range(DIMS))).first().asDict()


def keyed(table: DataFrame, stats: dict) -> DataFrame:
    """Add ``key``, the document's place on the curve."""
    mean = np.array([stats[f"m{k}"] or 0.0 for k in range(DIMS)])
    deviation = np.sqrt(np.maximum(np.array([stats[f"q{k}"] or 0.0 for k in range(DIMS)]) - mean * mean, 0))

    @F.pandas_udf("long")
    def place(*numbers: pd.Series) -> pd.Series:
        return pd.Series(hilbert(cells(np.stack([n.to_numpy() for n in numbers], axis=1).astype(float), mean, deviation)))

    names = [f"c{k}" for k in range(DIMS)]
    return table.withColumn("key", place(*names)).drop(*names)


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """Every document's ids in sequences: one row per piece.

    doc_id, start (the document's ids before the piece), length, ids_crc32 (of the ids as
    little-endian 32-bit numbers), doc_tokens (all its ids with the end mark), sequence_id,
    offset (in the sequence), key (the document's place on the curve), ids (the piece's, as
    such bytes; null where ``with_ids`` is off). Sequences hold ``length`` ids, the last ones
    of a range a power of two. A null or empty text is the end mark alone. Every row is
    packed, also one whose doc_id is null or repeated: equal ids then have pieces of several
    documents. Documents at the same place follow each other by row, so a place that very
    many share is cut like any other. Other columns are ignored. An empty table gives no
    pieces.
    """
    table = written(encoded(docs, vocabulary), "pack-ids")
    stats = measured(table)
    tokens = stats["tokens"] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    kind = Encoder(_read(vocabulary)).kind
    ranges = max(1, -(-kind.itemsize * tokens // RANGE_BYTES), min(cores, tokens // (64 * length)))

    def task(batches):
        def documents():
            for batch in batches:
                for doc, key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    yield (doc, key), np.frombuffer(ids.as_buffer(), kind)

        rows: list[tuple] = []
        number = TaskContext.get().partitionId() << 32  # ranges number their sequences apart
        for sequence in fill(documents(), length):
            offset = 0
            for (doc, key), start, ids, total in sequence:
                data = ids.astype("<u4").tobytes()
                rows.append((doc, start, len(ids), zlib.crc32(data), total, number, offset, key, data if with_ids else None))
                offset += len(ids)
            number += 1
            if len(rows) >= 4096:
                yield _pieces(rows)
                rows = []
        yield _pieces(rows)

    ordered = keyed(table, stats).repartitionByRange(ranges, "key", "row").sortWithinPartitions("key", "row")
    return ordered.select("doc_id", "key", "ids").mapInArrow(task, ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in PIECE_COLUMNS))


PIECE_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "key", "ids")


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], pa.binary() if n == "ids" else pa.int64()) for k, n in enumerate(PIECE_COLUMNS)], names=list(PIECE_COLUMNS))


def _read(vocabulary: str) -> str:
    with open(vocabulary, encoding="utf-8") as file:
        return file.read()
