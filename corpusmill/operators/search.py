"""Nearest-neighbour search for a batch of queries.

The query batch meets the vectors block against block: a numpy product inside
Arrow tasks that keeps the best k per query and task. No pair is ever a row, so
what leaves a task is at most k rows per query, whatever its input size.

* Up to ``MAX_BLOCK_QUERIES`` queries (size checked, never assumed) travel to all
  tasks as one broadcast block and the vectors are scanned in place.
* Beyond that, vectors and queries are laid out on a grid of equal cells and each
  cell is one bounded cogroup; nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.keys import MAX_PUSHED_KEYS, among
from corpusmill.schema import CANDIDATE_K, ROW_COLUMNS

MAX_BLOCK_QUERIES = 4096
MAX_BLOCK_BYTES = 64 << 20
GRID_QUERY_BYTES = 256 << 20
MAX_SCORE_CELLS = 4_000_000
#: Rows of a batch that a scanning task holds as doubles at a time.
SLICE_ROWS = 4096
MAX_BROADCAST_HITS = 200_000
MAX_CELL_FILTER = 10_000
MERGE_SALTS = 64


@dataclass
class QueryBlock:
    """A bounded part of the query batch, as one task sees it."""

    ids: pa.Array
    matrix: np.ndarray
    languages: list[str | None]
    cells: list[np.ndarray] | None

    @classmethod
    def of(cls, table: pa.Table) -> QueryBlock:
        cells = None
        if "qcells" in table.column_names:
            cells = [np.asarray(c, dtype=np.int64) for c in table["qcells"].to_pylist()]
        return cls(
            ids=table["query_id"].combine_chunks(),
            matrix=_unit_rows(_matrix(table["qvec"])),
            languages=[lang or None for lang in table["qlanguage"].to_pylist()],
            cells=cells,
        )


def _matrix(column) -> np.ndarray:
    """A list column as an (n, dim) matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.empty((0, 0))
    sizes = column.value_lengths()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dim = len(flat) // n
    if sizes.null_count or not np.all(sizes.to_numpy(zero_copy_only=False) == dim):
        raise ValueError("vectors of different lengths in one table")
    return flat.reshape(n, dim)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    """The rows at length 1, in place."""
    for at in range(0, len(m), 512):
        rows = m[at:at + 512]
        norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        norms[norms == 0] = 1.0
        rows /= norms
    return m


def _row_cells(column) -> tuple[np.ndarray, np.ndarray]:
    """A list-of-cells column as (row number, cell) pairs sorted by cell."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(column)), sizes)
    cells = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(cells, kind="stable")
    return rows[order], cells[order]


def _groups(queries: QueryBlock, batch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query numbers, row numbers) to compare: by language filter, then by cell."""
    n = batch.num_rows
    if "language" in batch.schema.names:
        languages = np.asarray(batch["language"].to_pylist(), dtype=object)
    else:
        languages = np.full(n, None, dtype=object)
    wanted = np.asarray(queries.languages, dtype=object)
    if queries.cells is not None:
        cell_rows, cell_keys = _row_cells(batch["cells"])
        sizes = [len(c) for c in queries.cells]
        probe_query = np.repeat(np.arange(len(sizes)), sizes)
        probe_cell = np.concatenate(queries.cells) if sizes else np.empty(0, np.int64)
    for language in set(queries.languages):
        asked = np.array([x == language for x in wanted], dtype=bool)
        allowed = np.ones(n, dtype=bool) if language is None else languages == language
        if queries.cells is None:
            yield np.flatnonzero(asked), np.flatnonzero(allowed)
            continue
        for cell in np.unique(probe_cell[asked[probe_query]]):
            lo, hi = np.searchsorted(cell_keys, [cell, cell + 1])
            rows = cell_rows[lo:hi]
            rows = rows[allowed[rows]]
            who = np.unique(probe_query[(probe_cell == cell) & asked[probe_query]])
            if len(rows):
                yield who, rows


def _best_k(pos, ids, scores, k: int) -> np.ndarray:
    """Row numbers of the best k per query by (score desc, id), sorted so."""
    order = np.lexsort((ids, -scores, pos))
    sorted_pos, sorted_ids = pos[order], ids[order]
    # Several cells may hold the same row; its copies are neighbours here.
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (sorted_pos[1:] != sorted_pos[:-1]) | (sorted_ids[1:] != sorted_ids[:-1])
    order, sorted_pos = order[fresh], sorted_pos[fresh]
    if not len(order):
        return order
    starts = np.flatnonzero(np.r_[True, sorted_pos[1:] != sorted_pos[:-1]])
    lengths = np.diff(np.r_[starts, len(order)])
    nth = np.arange(len(order)) - np.repeat(starts, lengths)
    return order[nth < k]


def _kept(s: np.ndarray, floor: np.ndarray, k: int, id_order) -> np.ndarray:
    """Which scores may still be among the best k of their query (a row of ``s``).

    At most k per query: of the rows tied at the last place only the first ids
    stay, so a block full of copies yields no more than any other.
    """
    n = s.shape[1]
    bar = floor
    if n > k:
        bar = np.maximum(bar, np.partition(s, n - k, axis=1)[:, n - k])
    keep = s >= bar[:, None]
    crowded = np.flatnonzero(keep.sum(axis=1) > k)
    if len(crowded):
        order = id_order()
        rows, edge = s[crowded][:, order], bar[crowded][:, None]
        above, tied = rows > edge, rows == edge
        room = k - above.sum(axis=1, keepdims=True)
        chosen = above | (tied & (np.cumsum(tied, axis=1) <= room))
        back = np.empty_like(order)
        back[order] = np.arange(n)
        keep[crowded] = chosen[:, back]
    return keep


Products = Callable[[np.ndarray], Callable[[np.ndarray], np.ndarray]]


@dataclass(frozen=True)
class Kernel:
    """How a batch is scored: its column, and products of query and row numbers.

    ``products(queries, batch)`` takes row numbers, then query numbers, and gives their
    cosines as a (queries x rows) matrix.
    """

    column: str
    products: Callable[[QueryBlock, pa.RecordBatch], Products]


def _vector_products(queries: QueryBlock, batch) -> Products:
    vectors = _unit_rows(_matrix(batch["vector"]))
    if vectors.shape[1] != queries.matrix.shape[1]:
        raise ValueError("query and index vectors differ in length")

    def of_rows(where):
        block = (vectors if len(where) == len(vectors) else vectors[where]).T
        return lambda part: queries.matrix[part] @ block

    return of_rows


VECTORS = Kernel("vector", _vector_products)


def top_rows(
    queries: QueryBlock, batches: Iterable, k: int, carry: list[str], kernel: Kernel = VECTORS,
) -> pa.RecordBatch | None:
    """Best k rows per query over all batches of a task."""
    if not len(queries.ids):
        return None
    keep = ["id", *carry]
    floor = np.full(len(queries.ids), -np.inf)
    pos, scores, rows = np.empty(0, np.int64), np.empty(0), None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        of_rows = kernel.products(queries, batch)
        new_pos, new_row, new_score = [], [], []

        def id_order(where, batch=batch):
            ids = batch["id"].take(pa.array(where)).to_pylist()
            return np.argsort(np.asarray(ids, dtype=np.str_), kind="stable")

        for who, where in _groups(queries, batch):
            if not len(where):
                continue
            scores_of = of_rows(where)
            step = max(1, MAX_SCORE_CELLS // len(where))
            for at in range(0, len(who), step):
                part = who[at:at + step]
                s = np.round(scores_of(part), 6) + 0.0
                qi, ri = np.nonzero(_kept(s, floor[part], k, lambda: id_order(where)))
                new_pos.append(part[qi])
                new_row.append(where[ri])
                new_score.append(s[qi, ri])
        if not new_pos:
            continue
        taken = pa.array(np.concatenate(new_row))
        found = pa.table({c: batch[c] for c in keep}).take(taken)
        rows = found if rows is None else pa.concat_tables([rows, found])
        pos = np.concatenate([pos, *new_pos])
        scores = np.concatenate([scores, *new_score])
        ids = np.asarray(rows["id"].to_pylist(), dtype=np.str_)
        best = _best_k(pos, ids, scores, k)
        rows, pos, scores = rows.take(pa.array(best)), pos[best], scores[best]
        full = np.bincount(pos, minlength=len(floor)) >= k
        # Rows are sorted by query and falling score: the last write is the k-th.
        kth_score = np.full(len(floor), -np.inf)
        kth_score[pos] = scores
        floor = np.where(full, kth_score, floor)
    if rows is None:
        return None
    columns = {"query_id": queries.ids.take(pa.array(pos)), "score": pa.array(scores)}
    columns.update({c: rows[c].combine_chunks() for c in keep})
    return pa.RecordBatch.from_pydict(columns)


def _hit_schema(index: DataFrame, queries: DataFrame, carry: list[str]) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("score", T.DoubleType()),
        *[T.StructField(c, index.schema[c].dataType) for c in ["id", *carry]],
    ])


def _query_columns(queries: DataFrame) -> DataFrame:
    language = F.col("language") if "language" in queries.columns else F.lit(None)
    extra = ["qcells"] if "qcells" in queries.columns else []
    return queries.where(F.col("qvec").isNotNull()).select(
        "query_id", "qvec", language.cast("string").alias("qlanguage"), *extra)


def _vector_names(index: DataFrame, carry: list[str], with_cells: bool, kernel: Kernel) -> list[str]:
    names = ["id", kernel.column, *carry]
    names += ["language"] if "language" in index.columns else []
    return names + (["cells"] if with_cells else [])


def _vector_rows(index: DataFrame, kernel: Kernel) -> DataFrame:
    return index.where(F.col(kernel.column).isNotNull())


def _scan_candidates(index, block: pa.Table, k, carry, schema, kernel) -> DataFrame:
    """Broadcast-block plan: scan the vectors in place."""
    with_cells = "qcells" in block.column_names
    languages = {x or None for x in block["qlanguage"].to_pylist()}
    vectors = _vector_rows(index, kernel)
    if languages and None not in languages and "language" in index.columns:
        # Every query names a language: let the scan skip the others.
        vectors = vectors.where(F.col("language").isin(sorted(languages)))
    if with_cells and "cell" in index.columns:
        probed = {c for cells in block["qcells"].to_pylist() for c in cells}
        if len(probed) <= MAX_CELL_FILTER:
            # On a table partitioned by cell this skips the files of all other cells.
            vectors = vectors.where(F.col("cell").isin(sorted(probed)))
    if languages == {None}:
        vectors = vectors.drop("language")
    vectors = vectors.select(*_vector_names(vectors, carry, with_cells, kernel))
    shared = index.sparkSession.sparkContext.broadcast(block)

    def search_task(batches):
        slices = (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS))
        best = top_rows(QueryBlock.of(shared.value), slices, k, carry, kernel)
        if best is not None:
            yield best

    return vectors.mapInArrow(search_task, schema)


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _grid_candidates(index, queries, k, carry, schema, dim: int, kernel) -> DataFrame:
    """Grid plan for query batches of any size.

    Each vector meets each column of queries once, each query each row of
    vectors once; cells are bounded on both sides because ids hash evenly.
    """
    with_cells = "qcells" in queries.columns
    per_column = max(1, GRID_QUERY_BYTES // (8 * dim))
    per_row = max(1, MAX_BLOCK_BYTES // (8 * dim))
    n_cols = -(-queries.count() // per_column)
    n_rows = max(1, -(-index.count() // per_row))
    vectors = _vector_rows(index, kernel).select(*_vector_names(index, carry, with_cells, kernel))
    left = vectors.withColumn("_row", F.pmod(F.xxhash64("id"), F.lit(n_rows))).withColumn(
        "_col", F.explode(_numbers(n_cols)))
    right = queries.withColumn("_col", F.pmod(F.xxhash64("query_id"), F.lit(n_cols))).withColumn(
        "_row", F.explode(_numbers(n_rows)))
    names = [f.name for f in schema]

    def cell_task(cell_vectors: pa.Table, cell_queries: pa.Table) -> pa.Table:
        best = None
        if cell_vectors.num_rows and cell_queries.num_rows:
            best = top_rows(QueryBlock.of(cell_queries), [cell_vectors], k, carry, kernel)
        if best is None:
            empty = {"query_id": cell_queries["query_id"].slice(0, 0),
                     "score": pa.array([], pa.float64())}
            empty.update({c: cell_vectors[c].slice(0, 0) for c in ["id", *carry]})
            return pa.table(empty).select(names)
        return pa.Table.from_batches([best]).select(names)

    return left.groupBy("_row", "_col").cogroup(
        right.groupBy("_row", "_col")).applyInArrow(cell_task, schema)


def _ranked(candidates: DataFrame, k: int) -> DataFrame:
    """Merge the tasks' best rows and number them.

    Candidates of one query come from every task. The salted exchange lets the
    window's partial group limit cut them to k per partition first, so no query
    sends more than salts x k rows to its final task.
    """
    salted = candidates.repartition(
        F.col("query_id"), F.pmod(F.xxhash64("id"), F.lit(MERGE_SALTS)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    ranked = salted.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


def _row_keys(index: DataFrame) -> list[str]:
    """id, plus the partition columns that let a join back skip whole files."""
    return ["id"] + [c for c in ["shard"] if c in index.columns]


def knn_search(
    index: DataFrame,
    queries: DataFrame,
    k: int = CANDIDATE_K,
    with_rows: bool = True,
    push_ids: bool = False,
    kernel: Kernel = VECTORS,
) -> DataFrame:
    """Top-k rows per query by cosine score, ties by id.

    ``queries``: query_id, qvec, optional language (null or '' = no filter, which
    applies before the top-k). Output: query_id, rank, score, id and, with
    ``with_rows``, the text and metadata, fetched after the top-k so that wide
    columns stay out of the comparison. Reads the query side once while planning.
    ``push_ids`` is for a saved index: where the hits are few by count, the search
    runs at once and its ids go into the scan that fetches the rows, see
    :func:`attach_pushed`.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    asked = _query_columns(queries)
    carry = _row_keys(index)[1:]
    schema = _hit_schema(index, queries, carry)
    block = asked.limit(MAX_BLOCK_QUERIES + 1).toArrow()
    fits = block.num_rows <= MAX_BLOCK_QUERIES and block.nbytes <= MAX_BLOCK_BYTES
    if fits:
        candidates = _scan_candidates(index, block, k, carry, schema, kernel)
    else:
        dim = len(block["qvec"][0].as_py())
        candidates = _grid_candidates(index, asked, k, carry, schema, dim, kernel)
    hits = _ranked(candidates, k)
    if not with_rows:
        return hits.select("query_id", "rank", "score", "id")
    if push_ids and fits and block.num_rows * k <= MAX_PUSHED_KEYS:
        return attach_pushed(hits, index)
    return attach_rows(hits, index, fits and block.num_rows * k <= MAX_BROADCAST_HITS)


def held(queries: DataFrame) -> DataFrame:
    """A query batch that fits one block as a local table, so that it is evaluated once."""
    block = queries.limit(MAX_BLOCK_QUERIES + 1).toArrow()
    if block.num_rows > MAX_BLOCK_QUERIES or block.nbytes > MAX_BLOCK_BYTES:
        return queries
    return queries.sparkSession.createDataFrame(block, queries.schema)


def few_hits(queries: DataFrame, k: int) -> bool:
    """Whether k hits for each query are few enough to broadcast; counts the queries."""
    most = MAX_BROADCAST_HITS // k
    return queries.limit(most + 1).count() <= most


def attach_rows(hits: DataFrame, index: DataFrame, small: bool = False) -> DataFrame:
    """Join text and metadata back onto hits.

    ``small`` says that the number of hits was checked against
    ``MAX_BROADCAST_HITS``; otherwise Spark sizes the join itself.
    """
    keys = _row_keys(index)
    have = [c for c in ROW_COLUMNS if c in index.columns]
    rows = index.select(*keys, *have)
    picked = F.broadcast(hits) if small else hits
    return rows.join(picked, keys).select("query_id", "rank", "score", "id", *have)


def attach_pushed(hits: DataFrame, index: DataFrame) -> DataFrame:
    """:func:`attach_rows` for at most ``MAX_PUSHED_KEYS`` hits; runs the search.

    The hits come to the driver and their ids, and the shards they lie in, are
    filters of the scan: parquet skips the row groups whose Bloom filter has none of
    the ids, and the pages of sorted files whose bounds hold none.
    """
    found = hits.select("query_id", "rank", "score", *_row_keys(index)).toArrow()
    rows = index.where(among("id", found["id"].to_pylist()))
    if "shard" in found.column_names:
        rows = rows.where(F.col("shard").isin(sorted(set(found["shard"].to_pylist()))))
    return attach_rows(index.sparkSession.createDataFrame(found), rows, small=True)
