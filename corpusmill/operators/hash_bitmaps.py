"""Bitmaps of stored hashes: a load finds most of its new chunks without the index.

A text hash sets one bit out of ``BITS_PER_HASH`` for each hash that the table is laid
out for. The bits are cut into buckets of 32,768, a row of 4 KB each: 4 bytes a hash at most
where the column itself has 32. A hash whose bit is not set is stored nowhere; only the
others, the stored ones and about one in ``BITS_PER_HASH`` of the new, are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.keys import MAX_PUSHED_KEYS, among
from corpusmill.operators.maintenance import dedup_chunks, stored_hashes

BITS_PER_HASH = 16
BUCKET_BITS = 32_768  # fixed by Spark's bitmap functions
MAX_BROADCAST_HASHES = 500_000  # of 32 characters


def bucket_count(hashes: int) -> int:
    """Buckets for so many hashes, with as much room again to grow."""
    return max(1, -(-2 * hashes * BITS_PER_HASH // BUCKET_BITS))


def _number(buckets: int) -> Column:
    """The number of a hash's bit, counted from 1 as Spark's bitmap functions do."""
    return F.pmod(F.xxhash64("text_hash"), F.lit(buckets * BUCKET_BITS)) + 1


def hash_bitmaps(index: DataFrame, buckets: int) -> DataFrame:
    """(buckets, bucket, bits) of the stored hashes; an index without any gives no row.

    The numbers of the bits are shuffled, 16 bytes a row. Aggregated before the exchange,
    each task would send a bitmap of 4 KB for nearly every one of its hashes.
    """
    number = _number(buckets)
    bits = stored_hashes(index).select(
        F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("bit"))
    return bits.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).select(
        F.lit(buckets).alias("buckets"), "bucket", "bits")


def merged(bitmaps: DataFrame) -> DataFrame:
    """One row per bucket out of those of several versions."""
    return bitmaps.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def possible_hashes(chunks: DataFrame, bitmaps: DataFrame, buckets: int) -> DataFrame:
    """Distinct hashes of the chunks whose bit is set; all stored ones are among them.

    An inner join, so that Spark may send the smaller side, whichever it is.
    """
    number = _number(buckets)
    asked = chunks.select("text_hash").distinct().select(
        "text_hash", F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).cast("int").alias("bit"))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright("bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod("bit", F.lit(8)))), F.lit(2)) == 1
    return asked.join(bitmaps, "bucket").where(is_set).select("text_hash")


def stored_among(index: DataFrame, possible: DataFrame) -> DataFrame:
    """Those of the (written) hashes that are stored.

    Up to ``MAX_PUSHED_KEYS`` are a filter of the scan, which skips row groups by their
    Bloom filters. Beyond that the stored column is joined; its other side is small.
    """
    some = [r["text_hash"] for r in possible.where("text_hash is not null").limit(MAX_PUSHED_KEYS + 1).collect()]
    stored = stored_hashes(index)
    if len(some) <= MAX_PUSHED_KEYS:
        return stored.where(among("text_hash", some)).distinct()
    return stored.join(possible, "text_hash", "left_semi").distinct()


def absent_chunks(chunks: DataFrame, present: DataFrame, few: bool = False) -> DataFrame:
    """Deduplicated chunks whose hash is not among the present ones.

    ``few`` says that the present hashes were checked against ``MAX_BROADCAST_HASHES``: then
    stored chunks go before any text is moved. Otherwise the copies of a hash go first, so
    that each task sends one row of a hash.
    """
    if few:
        return dedup_chunks(chunks.join(F.broadcast(present), "text_hash", "left_anti"))
    return dedup_chunks(chunks).join(present, "text_hash", "left_anti")
