"""Word and gram hashes of whole Arrow text columns, computed on their bytes.

An Arrow string column is one byte buffer with offsets, so words are found and hashed
for many documents at once, without making a Python object for any of them. Work goes
in pieces of a bounded number of bytes, cut between words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 19

#: Odd, so that it has an inverse modulo 2**64.
_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class _Tables(dict):
    """Derived arrays, made where they are needed; task code travels without them."""

    def __reduce__(self):
        return _Tables, ()


_tables = _Tables()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(name: str, step: int, n: int) -> np.ndarray:
    """step**0, step**1, ... modulo 2**64, at least n of them."""
    have = _tables.get(name)
    if have is None or len(have) < n:
        base = np.full(max(n, PIECE_BYTES + 4096), step & _MASK, dtype=np.uint64)
        base[0] = 1
        have = _tables[name] = np.multiply.accumulate(base)
    return have


def byte_values() -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    if "bytes" not in _tables:
        _tables["bytes"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
    return _tables["bytes"]


def space_table() -> np.ndarray:
    """True for the bytes between words: 0x20 and 0x09 to 0x0D."""
    if "space" not in _tables:
        table = np.zeros(256, dtype=bool)
        table[[0x20, *range(0x09, 0x0E)]] = True
        _tables["space"] = table
    return _tables["space"]


def lower_table() -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    if "lower" not in _tables:
        table = np.arange(256, dtype=np.uint8)
        table[65:91] += 32
        _tables["lower"] = table
    return _tables["lower"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("") if not pa.types.is_binary(column.type) \
        else column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def row_blocks(offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def segment_hashes(data: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A hash of each segment data[starts[i]:starts[i+1]], bytes of value 0 not counting.

    The sum of values[byte] * step**position, divided by step**start: equal segments
    have equal sums wherever they stand.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    weighted = values[data]
    weighted *= _powers("step", _STEP, len(data) + 1)[:len(data)]
    sums = np.add.reduceat(weighted, starts)
    return mix(sums * _powers("back", pow(_STEP, -1, 1 << 64), len(data) + 1)[starts])


def letter_breaks() -> np.ndarray:
    """True for all ASCII bytes but letters and digits: words without their punctuation."""
    if "letters" not in _tables:
        table = np.zeros(256, dtype=bool)
        table[:128] = True
        table[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
        _tables["letters"] = table
    return _tables["letters"]


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = False, breaks: np.ndarray | None = None,
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, document bound) of all words of the texts.

    Words are maximal runs of bytes other than 0x20 and 0x09-0x0D within a text. The
    words of text i are those from bound[i] to bound[i + 1]. ``fold`` lower-cases A-Z;
    ``breaks`` names other bytes to stand between words.
    """
    breaks = space_table() if breaks is None else breaks
    space = breaks[data]
    first = ~space
    if len(data):
        first[1:] &= space[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = ~space[inner]
    starts = np.flatnonzero(first)
    bound = np.searchsorted(starts, offsets)
    values = byte_values().copy()
    if fold:
        values = values[lower_table()]
    values[breaks] = 0
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        begin = starts[at]
        end = int(np.searchsorted(starts, begin + PIECE_BYTES, side="right"))
        stop = len(data) if end >= len(starts) else starts[end]
        hashes[at:end] = segment_hashes(data[begin:stop], starts[at:end] - begin, values)
        at = end
    return hashes, starts, bound


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n consecutive hashes (fewer than n: none)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for j in range(n):
        total += hashes[j:j + count] * np.uint64(pow(_STEP, 2 * j + 1, 1 << 64))
    return mix(total)


def sequence_hash(hashes: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a whole sequence of hashes, as two signed numbers."""
    position = _powers("step", _STEP, len(hashes) + 1)[:len(hashes)]
    one = mix(np.array([np.sum(hashes * position, dtype=np.uint64) + np.uint64(len(hashes))]))
    two = mix(np.array([np.sum(mix(hashes + position), dtype=np.uint64)]))
    return int(one.view(np.int64)[0]), int(two.view(np.int64)[0])


def grams_of_rows(values: np.ndarray) -> np.ndarray:
    """One hash for each row of a matrix."""
    total = np.zeros(len(values), np.uint64)
    for j in range(values.shape[1]):
        total += mix(values[:, j].astype(np.uint64) + np.uint64(j + 1)) * np.uint64(pow(_STEP, 2 * j + 1, 1 << 64))
    return mix(total)
