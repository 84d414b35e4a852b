"""Approximate nearest neighbours: inverted cells, random projections, 8-bit codes.

All three use the block kernel of the exact search. A vector carries the cells it
lies in, a query the cells it probes, and only matching rows are compared, where
they are: a cell that holds a third of all vectors stays spread over its tasks.
Judge any of them on recall together with the share of pairs compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import vectors as vx
from corpusmill.operators.search import (
    Kernel,
    Products,
    QueryBlock,
    _matrix,
    _unit_rows,
    few_hits,
    held,
    knn_search,
)
from corpusmill.schema import CANDIDATE_K

_LONGS = T.ArrayType(T.LongType())


# Inverted cells


def fit_cells(index: DataFrame, cells: int = 16, seed: int = 42) -> np.ndarray:
    """K-means centres (cells x dim), fitted on all vectors; runs jobs.

    Fit once per index and keep the centres: queries only need the assignment.
    """
    points = index.where(F.col("vector").isNotNull()).select(array_to_vector("vector").alias("features"))
    fitted = KMeans(k=cells, seed=seed, distanceMeasure="cosine", maxIter=10).fit(points)
    return np.array(fitted.clusterCenters())


def _nearest_cells(df: DataFrame, vector: str, into: str, centers: np.ndarray, n: int) -> DataFrame:
    """Add the n nearest centres of each vector, nearest first."""
    unit = _unit_rows(centers.astype(np.float64))
    schema = T.StructType([*df.schema.fields, T.StructField(into, _LONGS)])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = _unit_rows(_matrix(batch[vector])) @ unit.T
            nearest = np.argsort(-scores, axis=1, kind="stable")[:, :n].astype(np.int64)
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * nearest.shape[1]
            cells = pa.ListArray.from_arrays(pa.array(offsets), pa.array(nearest.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, cells], names=[*batch.schema.names, into])

    return df.where(F.col(vector).isNotNull()).mapInArrow(assign, schema)


def assign_cells(index: DataFrame, centers: np.ndarray) -> DataFrame:
    """Index with its cell; write it partitioned by ``cell`` to let probes prune."""
    with_list = _nearest_cells(index, "vector", "cells", centers, 1)
    return with_list.withColumn("cell", F.col("cells")[0])


def ann_ivf(
    celled: DataFrame,
    queries: DataFrame,
    centers: np.ndarray,
    probes: int = 4,
    k: int = CANDIDATE_K,
    with_rows: bool = True,
) -> DataFrame:
    """Top-k among the vectors in each query's nearest cells.

    ``celled`` comes from :func:`assign_cells`, directly or read back from a
    table partitioned by ``cell``.
    """
    if "cells" not in celled.columns:
        celled = celled.withColumn("cells", F.array(F.col("cell").cast("long")))
    probing = _nearest_cells(queries, "qvec", "qcells", centers, probes)
    return knn_search(celled, probing, k, with_rows)


# Random projections


@dataclass
class LshCells:
    """A fitted projection model and the two tables with their buckets."""

    index: DataFrame
    queries: DataFrame


def _buckets(model, df: DataFrame, vector: str, into: str) -> DataFrame:
    featured = df.where(F.col(vector).isNotNull()).withColumn(
        "_features", array_to_vector(F.col(vector)))
    hashed = model.transform(featured)
    # One cell per table: the table number keeps equal buckets of two tables apart.
    cells = F.transform(
        F.col("_hashes"),
        lambda h, i: F.xxhash64(i, vector_to_array(h)[0]))
    return hashed.withColumn(into, cells).drop("_features", "_hashes")


def lsh_cells(
    index: DataFrame,
    queries: DataFrame,
    bucket_length: float = 0.5,
    tables: int = 4,
    seed: int = 42,
) -> LshCells:
    lsh = BucketedRandomProjectionLSH(
        inputCol="_features", outputCol="_hashes", seed=seed,
        bucketLength=bucket_length, numHashTables=tables)
    featured = index.where(F.col("vector").isNotNull()).select(
        array_to_vector(F.col("vector")).alias("_features"))
    fitted = lsh.fit(featured)
    return LshCells(
        index=_buckets(fitted, index, "vector", "cells"),
        queries=_buckets(fitted, queries, "qvec", "qcells"))


def ann_lsh(
    index: DataFrame,
    queries: DataFrame,
    k: int = CANDIDATE_K,
    bucket_length: float = 0.5,
    tables: int = 4,
    seed: int = 42,
    with_rows: bool = True,
) -> DataFrame:
    """Top-k among the vectors sharing a bucket with the query in any table."""
    cells = lsh_cells(index, queries, bucket_length, tables, seed)
    return knn_search(cells.index, cells.queries, k, with_rows)


def compared_pairs(celled: DataFrame, probing: DataFrame) -> DataFrame:
    """One row: vector comparisons a cell search does, and those of the exact one.

    Counts per cell are aggregated on both sides before they meet, so no pair is
    formed. A pair that shares several tables counts once for each.
    """
    rows = celled.select(F.explode("cells").alias("cell")).groupBy("cell").agg(
        F.count("*").alias("rows"))
    asked = probing.select(F.explode("qcells").alias("cell")).groupBy("cell").agg(
        F.count("*").alias("asked"))
    done = rows.join(asked, "cell").agg(
        F.coalesce(F.sum(F.col("rows") * F.col("asked")), F.lit(0)).alias("compared"))
    n_rows = celled.agg(F.count("*"))
    n_asked = probing.agg(F.count("*"))
    return done.withColumn("exact", n_rows.scalar() * n_asked.scalar())


# 8-bit codes


@dataclass(frozen=True)
class Quantizer:
    """Per-dimension bounds; two arrays of the vector's length."""

    low: np.ndarray
    high: np.ndarray

    @property
    def step(self) -> np.ndarray:
        return self.high - self.low


def fit_quantizer(index: DataFrame) -> Quantizer:
    """Bounds by one map-side combined aggregation; its one row is collected."""
    features = index.where(F.col("vector").isNotNull()).select(
        array_to_vector(F.col("vector")).alias("features"))
    bounds = features.select(
        Summarizer.metrics("min", "max").summary(F.col("features")).alias("s"),
    ).select("s.min", "s.max").first()
    return Quantizer(bounds["min"].toArray(), bounds["max"].toArray())


def _list_array(values: np.ndarray) -> pa.Array:
    n, dim = values.shape
    offsets = np.arange(n + 1, dtype=np.int32) * dim
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def _codes(m: np.ndarray, quantizer: Quantizer) -> np.ndarray:
    step = quantizer.step
    share = np.where(step > 0, (m - quantizer.low) / np.where(step > 0, step, 1.0), 0.0)
    return np.floor(np.clip(share, 0.0, 1.0) * 255 + 0.5).astype(np.uint8)


def pack_codes(index: DataFrame, quantizer: Quantizer) -> DataFrame:
    """Replace ``vector`` by ``codes`` as bytes, one per dimension: the form to store."""
    dim = len(quantizer.low)

    @F.arrow_udf(T.BinaryType())
    def encode(vectors: pa.Array) -> pa.Array:
        m = _matrix(vectors)
        if m.shape[1] not in (0, dim):
            raise ValueError("vectors and quantizer differ in length")
        offsets = pa.py_buffer(np.arange(len(m) + 1, dtype=np.int32) * dim)
        return pa.Array.from_buffers(
            pa.binary(), len(m), [None, offsets, pa.py_buffer(_codes(m, quantizer).tobytes())])

    rows = index.where(F.col("vector").isNotNull())
    return rows.withColumn("codes", encode(F.col("vector"))).drop("vector")


def _code_kernel(quantizer: Quantizer) -> Kernel:
    """Cosines of queries and coded rows without decoding a row.

    A row is low + scale * code, so its product with a query is the product of the codes
    with the scaled query, plus one number per query; its length comes from two more
    products of the codes.
    """
    low, scale = quantizer.low, quantizer.step / 255

    def products(queries: QueryBlock, batch) -> Products:
        column = batch["codes"]
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if pa.types.is_binary(column.type):
            offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
            if not np.all(np.diff(offsets) == len(low)):
                raise ValueError("codes of different lengths in one table")
            codes = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
            codes = codes.reshape(len(column), len(low)).astype(np.float64)
        else:
            codes = _matrix(column)
        if queries.matrix.shape[1] != codes.shape[1]:
            raise ValueError("query and index vectors differ in length")
        scaled, fixed = queries.matrix * scale, queries.matrix @ low
        squares = low @ low + codes @ (2 * low * scale) + (codes * codes) @ (scale * scale)
        lengths = np.sqrt(np.maximum(squares, 0.0))
        lengths[lengths == 0] = 1.0

        def of_rows(where):
            block, norm = codes[where].T, lengths[where]
            return lambda part: (scaled[part] @ block + fixed[part, None]) / norm

        return of_rows

    return Kernel("codes", products)


def quantize_vectors(index: DataFrame, quantizer: Quantizer) -> DataFrame:
    """Replace ``vector`` by ``codes``, one number from 0 to 255 per dimension.

    An array to look into; :func:`pack_codes` gives the bytes to store and scan.
    """

    @F.arrow_udf(T.ArrayType(T.ShortType()))
    def encode(vectors: pa.Array) -> pa.Array:
        m = _matrix(vectors)
        if not m.size:
            return pa.array([[]] * len(vectors), pa.list_(pa.int16()))
        return _list_array(_codes(m, quantizer).astype(np.int16))

    rows = index.where(F.col("vector").isNotNull())
    return rows.withColumn("codes", encode(F.col("vector"))).drop("vector")


def dequantize(coded: DataFrame, quantizer: Quantizer) -> DataFrame:
    """Codes back to approximate vectors."""
    low, step = quantizer.low, quantizer.step

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def decode(codes: pa.Array) -> pa.Array:
        m = _matrix(codes)
        if not m.size:
            return pa.array([[]] * len(codes), pa.list_(pa.float32()))
        return _list_array((low + m / 255 * step).astype(np.float32))

    return coded.withColumn("vector", decode(F.col("codes"))).drop("codes")


def knn_quantized(
    coded: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    quantizer: Quantizer,
    k: int = CANDIDATE_K,
    refine: int = 2,
) -> DataFrame:
    """Scan the codes for the best ``refine * k``, re-score those exactly.

    ``coded`` (bytes of :func:`pack_codes` or arrays) is the narrow table that is scanned
    in full and never decoded; of ``vectors`` (id, vector) only the candidates' rows are used.
    """
    queries = held(queries)
    rough = knn_search(coded, queries, k * refine, with_rows=False, kernel=_code_kernel(quantizer))
    picked = rough.select("query_id", "id")
    if few_hits(queries, k * refine):
        picked = F.broadcast(picked)
    exact = vectors.select("id", "vector").join(picked, "id").join(
        queries.select("query_id", "qvec"), "query_id")
    scored = exact.withColumn("score", vx.cosine(F.col("qvec"), F.col("vector")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "score", "id")
