"""Attach unit vectors to texts: a built-in hashed encoder, or a user's model."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import text as tx
from corpusmill.schema import (
    EMBED_BATCH_ROWS,
    EMBED_DIM,
    PASSAGE_PREFIX,
    QUERY_PREFIX,
)

Encoder = Callable[[Column], Column]


def _buckets(words: pa.Array, dim: int) -> np.ndarray:
    """Hash bucket of each word: leading 8 hex digits of its md5, modulo ``dim``. Equal words are hashed once."""
    coded = words.dictionary_encode()
    n = len(coded.dictionary)
    if not n:
        return np.empty(0, np.int64)
    # One string of them all, as a word at a time takes Arrow longer than its hash.
    line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), coded.dictionary.cast(pa.binary())), b" ")
    digests = b"".join([md5(w, usedforsecurity=False).digest() for w in line[0].as_buffer().to_pybytes().split(b" ")])
    heads = np.frombuffer(digests, ">u4").reshape(n, 4)[:, 0].astype(np.int64)
    return (heads % dim)[coded.indices.to_numpy()]


def _unit_counts(dim: int, max_tokens: int | None):
    """Arrow UDF: words between single spaces to unit vectors of bucket counts.

    A token is a one-hot vector, so the counts are the mean pool up to a factor
    that the normalisation removes.
    """

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def unit_counts(spaced: pa.Array) -> pa.Array:
        out = np.empty((len(spaced), dim), np.float32)
        for at in range(0, len(spaced), 512):
            lists = pc.split_pattern(spaced.slice(at, 512), " ")
            n = len(lists)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            words = lists.flatten()
            # A text that begins or ends between words has an empty piece there.
            full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
            row = np.repeat(np.arange(n, dtype=np.int64), sizes)[full]
            words = words.filter(pa.array(full))
            if max_tokens is not None:
                head = np.arange(len(row)) - np.searchsorted(row, row) < max_tokens
                row, words = row[head], words.filter(pa.array(head))
            cell = row * dim + _buckets(words, dim)
            counts = np.bincount(cell, minlength=n * dim).reshape(n, dim).astype(np.float64)
            norms = np.sqrt((counts * counts).sum(axis=1))
            norms[norms == 0] = 1.0
            out[at:at + n] = counts / norms[:, None]
        offsets = np.arange(len(spaced) + 1, dtype=np.int32) * dim
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))

    return unit_counts


def hashed(dim: int = EMBED_DIM, max_tokens: int | None = None) -> Encoder:
    """Built-in encoder: no model, reads the whole text.

    Tokenising is a Spark expression; the words cross to the Arrow worker, which
    hashes each distinct one of a slice once. ``max_tokens`` gives the input cap a
    model would have.
    """
    densify = _unit_counts(dim, max_tokens)

    def encode(text: Column) -> Column:
        return densify(tx.spaced_words(text))

    return encode


def model(make_predict_fn, dim: int, batch_rows: int = EMBED_BATCH_ROWS) -> Encoder:
    """Encoder around a user's model, loaded once per Python worker.

    ``make_predict_fn()`` returns a function from an array of texts to an
    ``(n, dim)`` float array; tokenising and truncation belong to the model.
    """
    predict = predict_batch_udf(
        make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_rows)
    return lambda text: predict(text)


def embed(
    texts: DataFrame,
    encoder: Encoder | None = None,
    prefix: str = PASSAGE_PREFIX,
    text: str = "text",
    into: str = "vector",
) -> DataFrame:
    encoder = encoder or hashed()
    return texts.withColumn(into, encoder(F.concat(F.lit(prefix), F.col(text))))


def embed_queries(queries: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    return embed(queries, encoder, prefix=QUERY_PREFIX, text="query", into="qvec")


def mean_pool(tokens: DataFrame, key: str, vec: str = "vec", mask: str = "mask") -> DataFrame:
    """Mean of the vectors with mask 1, per key, as an array of doubles.

    The mask is the summary's weight, so a key is combined map-side however many
    rows it has, and vectors are never exploded into one row per component. A
    key without unmasked rows has no mean and no output row.
    """
    used = tokens.where(F.col(mask) != 0)
    mean = Summarizer.mean(array_to_vector(F.col(vec)), F.col(mask).cast("double"))
    return used.groupBy(key).agg(mean.alias("mean")).select(
        key, vector_to_array("mean").alias(vec))
