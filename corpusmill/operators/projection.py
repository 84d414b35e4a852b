"""2-D map of the vectors by principal components."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.schema import MAP_MIN_ROWS


def pca_2d(index: DataFrame) -> DataFrame:
    """Index rows with centred ``x`` and ``y``; fits while planning.

    The covariance is combined across the tasks and has the size of the vector
    squared, however many rows there are. Each component's sign makes its
    largest loading positive.
    """
    rows = index.where(F.col("vector").isNotNull()).withColumn(
        "_features", array_to_vector(F.col("vector")))
    if len(rows.select("id").take(MAP_MIN_ROWS)) < MAP_MIN_ROWS:
        raise ValueError(f"the map needs at least {MAP_MIN_ROWS} rows")
    fitted = PCA(k=2, inputCol="_features", outputCol="_plane").fit(rows)
    loadings = fitted.pc.toArray()
    signs = [1.0 if loadings[np.argmax(np.abs(loadings[:, c])), c] >= 0 else -1.0 for c in (0, 1)]
    plane = fitted.transform(rows).withColumn("_xy", vector_to_array("_plane")).select(
        *index.columns,
        (F.col("_xy")[0] * signs[0]).alias("_x"),
        (F.col("_xy")[1] * signs[1]).alias("_y"))
    # The transform does not centre; the mean of the two coordinates does it.
    mean = plane.agg(F.avg("_x").alias("x"), F.avg("_y").alias("y")).first()
    return plane.select(
        *index.columns,
        (F.col("_x") - mean["x"]).alias("x"), (F.col("_y") - mean["y"]).alias("y"))


def map_points(projected: DataFrame) -> DataFrame:
    """The drawn columns of :func:`pca_2d` output."""
    path = F.coalesce("filepath", F.lit(""))
    return projected.select(
        "x", "y", path.alias("filepath"), tx.short_path(path).alias("short_filepath"),
        F.coalesce("language", F.lit("")).alias("language"),
        F.coalesce("node_type", F.lit("")).alias("node_type"),
        F.coalesce("start_line", F.lit(0)).alias("start_line"),
        tx.snippet(F.col("text")).alias("snippet"))


def map_legend(points: DataFrame, color_by: str = "language") -> DataFrame:
    """Points and extent per colour group; '' counts as 'unknown'."""
    if color_by not in ("language", "node_type"):
        raise ValueError("color_by must be 'language' or 'node_type'")
    key = tx.or_default(F.col(color_by), "unknown").alias("color")
    return points.groupBy(key).agg(
        F.count("*").alias("points"),
        F.min("x").alias("min_x"), F.max("x").alias("max_x"),
        F.min("y").alias("min_y"), F.max("y").alias("max_y"))
