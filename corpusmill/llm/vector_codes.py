"""Vectors as short codes: a codebook per part of the vector, fitted by active-entry Lloyd.

Components become integers, so all distances, sums and means are exact. Every vector
keeps, per part, its assigned entry and the distance to it. After the entries are
replaced, a part whose entry stayed where it was can only be drawn away by an entry that
moved: it is compared with those alone, against the stored distance. A part whose entry
moved is compared with all. Ties go to the lower index in both cases.

A round is a scan: tasks compare whole Arrow batches with the codebooks, a few thousand
integers, and the new state is written to the shared folder; sums per entry are added up in
the tasks first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from corpusmill.llm.tables import discard, written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
#: Components stay below this, so that errors fit in 63 bits.
LIMIT = 1 << 27
#: Vectors compared at a time.
ROWS = 2048


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 x) of finite components."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if len(scaled) and np.abs(scaled).max() >= LIMIT:
        raise OverflowError(f"a component reaches {LIMIT // SCALE}: squared distances would not fit in 64 bits")
    return scaled.astype(np.int64)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries."""
    size = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * size * size * x.shape[1] < 1 << 53:  # exact as floating point, which multiplies faster
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        gap = x[:, k, None] - entries[None, :, k]
        out += gap * gap
    return out


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, distance) of each row among all entries; of equal distances the lower index."""
    found = distances(x, entries)
    best = found.argmin(axis=1)
    return best, found[np.arange(len(x)), best]


def rescan(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, distance, comparisons) after the entries marked ``moved`` changed.

    ``code`` and ``error`` are the assignments before, ``error`` the distance to an entry that stayed.
    """
    code, error = code.copy(), error.copy()
    lost = moved[code]
    changed = np.flatnonzero(moved)
    stay = np.flatnonzero(~lost)
    if len(changed) and len(stay):
        at, gap = scan(x[stay], entries[changed])
        at = changed[at]
        nearer = (gap < error[stay]) | ((gap == error[stay]) & (at < code[stay]))
        code[stay[nearer]], error[stay[nearer]] = at[nearer], gap[nearer]
    if lost.any():
        code[lost], error[lost] = scan(x[lost], entries)
    return code, error, len(stay) * len(changed) + int(lost.sum()) * len(entries)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector of the rows whose vector has only finite components."""
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("vector")).filter(
        F.col("vector").isNotNull() & ~bad)


def _components(column: pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, size = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * size), pa.array(values.ravel(), kind))


def _first(vectors: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """Quantise, and assign every part by a complete scan."""
    parts, _, width = codebooks.shape
    schema = StructType([vectors.schema["vec_id"], vectors.schema["label"], StructField("vector", ArrayType(IntegerType())),
                         StructField("codes", ArrayType(IntegerType())), StructField("errors", ArrayType(LongType())), StructField("compared", LongType())])

    def task(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                piece = batch.slice(low, ROWS)
                x = integers(_components(piece.column(2), parts * width))
                found = [scan(x[:, p * width:(p + 1) * width], codebooks[p]) for p in range(parts)]
                codes, errors = (np.stack([f[k] for f in found], axis=1) for k in range(2))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), _lists(x, pa.int32()), _lists(codes, pa.int32()), _lists(errors, pa.int64()),
                     pa.array(np.full(len(x), codebooks.shape[0] * codebooks.shape[1]))],
                    names=["vec_id", "label", "vector", "codes", "errors", "compared"])

    return vectors.mapInArrow(task, schema)


def _next(state: DataFrame, codebooks: np.ndarray, moved: np.ndarray) -> DataFrame:
    """Assign anew after the entries marked ``moved`` changed."""
    parts, _, width = codebooks.shape

    def task(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                piece = batch.slice(low, ROWS)
                x = _components(piece.column("vector"), parts * width).astype(np.int64)
                codes = _components(piece.column("codes"), parts).astype(np.int64)
                errors = _components(piece.column("errors"), parts).astype(np.int64)
                compared = 0
                for p in range(parts):
                    codes[:, p], errors[:, p], n = rescan(x[:, p * width:(p + 1) * width], codebooks[p], moved[p], codes[:, p], errors[:, p])
                    compared += n
                # Comparisons of a piece, told on its first row.
                counts = np.zeros(len(x), np.int64)
                counts[:1] = compared
                yield pa.RecordBatch.from_arrays(
                    [piece.column("vec_id"), piece.column("label"), piece.column("vector"), _lists(codes, pa.int32()), _lists(errors, pa.int64()), pa.array(counts)],
                    names=["vec_id", "label", "vector", "codes", "errors", "compared"])

    return state.mapInArrow(task, state.schema)


def _moved(state: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Codebooks whose used entries are the floored means of their parts."""
    parts, entries, width = codebooks.shape
    places = [f"s{k}" for k in range(width)]

    def task(batches):
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _components(batch.column(0), parts * width).astype(np.int64)
            codes = _components(batch.column(1), parts)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], x[:, p * width:(p + 1) * width])
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), *(pa.array(sums[part, entry, k]) for k in range(width))],
            names=["part", "entry", "n", *places])

    added = state.select("vector", "codes").mapInArrow(task, "part int, entry int, n long, " + ", ".join(f"{p} long" for p in places))
    new = codebooks.copy()
    # One row per entry of a codebook: parts x entries at most.
    for row in added.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ("n", *places))).collect():
        new[row.part, row.entry] = [row[p] // row.n for p in places]
    return new


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def start(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """The parts of the vectors with the smallest ids; None without a vector. (part, entry, position)."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not first:
        return None
    size = len(first[0].vector)
    if not size or size % parts:
        raise ValueError(f"vectors of {size} components cannot be cut into {parts} equal parts")
    own = [r.vector for r in first if len(r.vector) == size]
    return integers(np.array(own)).reshape(len(own), parts, size // parts).transpose(1, 0, 2).copy()


class Codes:
    """Codebooks and codes of a table of vectors.

    ``vectors`` has vec_id and embedding, and maybe label. Rows whose vector is null or has
    null or non-finite components are left out. The first kept vector by id gives the
    number of components, which must be a multiple of ``parts`` (an error otherwise); empty
    vectors and those of another length are left out too. Equal ids are rows of their own,
    ordered by their vectors where the first ones are taken; a null id comes last. A
    component beyond 2**19 is an error, as its square would not fit. Other columns are
    ignored. An empty table has no codebooks and no codes.
    """

    def __init__(self, vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
        self.spark: SparkSession = vectors.sparkSession
        kept = usable(vectors).filter(F.size("vector") > 0)
        self.codebooks = start(kept, parts, entries)
        self.state: DataFrame | None = None
        #: Distances computed in each assignment.
        self.compared: list[int] = []
        self._ids = (kept.schema["vec_id"], kept.schema["label"])
        if self.codebooks is None:
            return
        size = parts * self.codebooks.shape[2]
        self._keep(_first(kept.filter(F.size("vector") == size), self.codebooks))
        for _ in range(rounds):
            new = _moved(self.state, self.codebooks)
            moved = (new != self.codebooks).any(axis=2)
            self.codebooks = new
            self._keep(_next(self.state, new, moved))

    def _keep(self, state: DataFrame) -> None:
        before, self.state = self.state, written(state, "vector-codes")
        if before is not None:
            discard(before)
        self.compared.append(self.state.agg(F.sum("compared")).first()[0] or 0)

    def codes(self) -> DataFrame:
        """vec_id, label, code (two hex digits a part), error (summed over parts)."""
        if self.state is None:
            return self.spark.createDataFrame([], StructType([*self._ids, StructField("code", StringType()), StructField("error", LongType())]))
        code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
        return self.state.select("vec_id", "label", code.alias("code"), F.aggregate("errors", F.lit(0).cast("long"), lambda a, x: a + x).alias("error"))

    def digested(self) -> DataFrame:
        """vec_id, code, error, label_error (over equal labels, nulls together), codebooks_sha256."""
        codes = self.codes()
        total = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
        name = digest(self.codebooks) if self.codebooks is not None else None
        return codes.join(total, F.col("label").eqNullSafe(F.col("of"))).select(
            "vec_id", "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))
