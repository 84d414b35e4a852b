"""Re-score candidate pairs and keep the best; the end-to-end search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import text as tx
from corpusmill.operators.embedding import Encoder, embed_queries
from corpusmill.operators.search import knn_search
from corpusmill.schema import CANDIDATE_K, EMBED_BATCH_ROWS, RESULT_N

Scorer = Callable[[Column, Column], Column]


def jaccard(query: Column, text: Column, max_tokens: int | None = None) -> Column:
    """Shared share of the distinct words.

    A stand-in for a pair model; its scores are not a model's scores.
    ``max_tokens`` gives it the pair cap of a model: the text keeps what the
    query leaves of it.
    """
    # One-element arrays bind the word lists and their sizes once per pair.
    asked, found = tx.words(query), tx.words(text)
    if max_tokens is not None:
        asked = tx.first_tokens(asked, max_tokens)
        found = F.slice(found, F.lit(1), F.greatest(F.lit(0), max_tokens - F.size(asked)))
    words = F.array(F.struct(
        F.array_distinct(asked).alias("asked"), F.array_distinct(found).alias("found")))
    sizes = F.transform(words, lambda w: F.struct(
        F.size(F.array_intersect(w["asked"], w["found"])).alias("shared"),
        (F.size(w["asked"]) + F.size(w["found"])).alias("both")))
    score = F.transform(sizes, lambda z: F.try_divide(
        z["shared"].cast("double"), (z["both"] - z["shared"]).cast("double")))
    return F.coalesce(F.round(score[0], 6), F.lit(0.0))


def model_scorer(make_predict_fn, batch_rows: int = EMBED_BATCH_ROWS) -> Scorer:
    """Scorer around a user's pair model: (queries, texts) to one score each."""
    predict = predict_batch_udf(
        make_predict_fn, return_type=T.DoubleType(), batch_size=batch_rows)
    return lambda query, text: predict(query, text)


def rerank(
    hits: DataFrame,
    queries: DataFrame,
    scorer: Scorer = jaccard,
    n: int = RESULT_N,
) -> DataFrame:
    """Best n candidates per query by rerank score; ties keep candidate order."""
    if n < 1:
        raise ValueError("n must be at least 1")
    if "text" not in hits.columns:
        raise ValueError("hits need a 'text' column")
    pairs = hits.withColumnRenamed("rank", "candidate_rank").join(
        queries.select("query_id", "query"), "query_id")
    scored = pairs.withColumn("rerank_score", scorer(F.col("query"), F.col("text")))
    order = Window.partitionBy("query_id").orderBy(
        F.desc("rerank_score"), F.asc("candidate_rank"))
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= n).drop("query")


def search_end_to_end(
    index: DataFrame,
    queries: DataFrame,
    encoder: Encoder | None = None,
    scorer: Scorer = jaccard,
    k: int = CANDIDATE_K,
    n: int = RESULT_N,
    push_ids: bool = False,
) -> DataFrame:
    """Embed the queries, take k nearest rows each, re-score, keep n.

    There are at most k rows to keep, so an n above k returns those. ``push_ids`` lets the
    scan of a saved index fetch only row groups that may hold hits (see :func:`knn_search`).
    """
    asked = embed_queries(queries, encoder)
    return rerank(knn_search(index, asked, k, push_ids=push_ids), queries, scorer, n)
