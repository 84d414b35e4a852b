"""Index and map tables on shared storage.

An index is three or four plain parquet tables under one path::

    rows/v=<n>-<writer>/language=<l>/shard=<s>/    rows of version n
    removed/v=<n>-<writer>/                        paths whose rows older than n are gone
    hashes/v=<n>-<writer>/                         bitmaps of the hashes of version n, if kept
    commits/v-<n>.parquet                          one row per finished version

A full save starts a new base; a refresh appends only its delta, so its cost
follows the change and not the index. Every writer has folders of its own, and a
version counts once its commit file is there. That file is moved into place and never
over another: of two writers of one version the second is refused, and what the first
wrote stays as it is. A job that dies half-way leaves nothing a reader would see.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators import hash_bitmaps as hb
from corpusmill.operators.embedding import Encoder, embed
from corpusmill.operators.maintenance import empty_index, lay_out, with_defaults
from corpusmill.schema import INDEX, INDEX_COLUMNS
from corpusmill.session import remove_dir, shared_dir

_COMMITS = T.StructType([
    T.StructField("version", T.LongType()),
    T.StructField("base", T.LongType()),
    T.StructField("token", T.StringType()),
    T.StructField("folder", T.StringType()),
])
#: Row groups tell which ids and paths they may hold, so a scan for a few skips the rest.
_FILTERS = {
    "parquet.bloom.filter.enabled#id": "true",
    "parquet.bloom.filter.enabled#filepath": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
}
_HASH_FILTER = {"parquet.bloom.filter.enabled#text_hash": "true"}
_BITMAPS = T.StructType([
    T.StructField("buckets", T.IntegerType()), T.StructField("bucket", T.LongType()),
    T.StructField("bits", T.BinaryType())])
_REMOVED = T.StructType([T.StructField("filepath", T.StringType()), T.StructField("v", T.StringType())])
_ROWS = T.StructType([
    *INDEX.fields, T.StructField("shard", T.IntegerType()), T.StructField("v", T.StringType())])


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_COMMITS).parquet(f"{path}/commits")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _state(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """(latest version, its base), or None without a committed version."""
    commits = _commits(spark, path)
    if commits is None:
        return None
    last = commits.agg(F.max("version").alias("version"), F.max("base").alias("base")).first()
    return None if last["version"] is None else (last["version"], last["base"])


def _commit(spark: SparkSession, path: str, version: int, base: int, token: str | None, folder: str | None = None) -> None:
    """Record a finished version; fails if another writer has finished it meanwhile.

    The commit row is written aside and its file moved to the version's name, which file
    systems with an atomic move do for one writer only.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    aside = f"{path}/uncommitted/{uuid.uuid4().hex}"
    spark.createDataFrame([(version, base, token, folder)], _COMMITS).coalesce(1).write.parquet(aside)
    at = jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    files = at(path).getFileSystem(conf)
    part = files.globStatus(at(f"{aside}/part-*"))[0].getPath()
    files.mkdirs(at(f"{path}/commits"))
    target = files.makeQualified(at(f"{path}/commits/v-{version}.parquet"))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    no_overwrite = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(part, target, no_overwrite)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        raise RuntimeError(f"version {version} of {path} was committed by another writer") from None
    finally:
        files.delete(at(aside), True)


def _write_rows(rows: DataFrame, path: str, version: int, shards: int, buckets: int | None = None,
                seen: Observation | None = None) -> str:
    """Write rows, and with ``buckets`` the bitmaps of their hashes (0: as many as suit them).

    Returns the name of the folder, which is this writer's own. ``seen`` counts the rows
    in the tasks that write them.
    """
    folder = f"{version}-{uuid.uuid4().hex}"
    if "shard" not in rows.columns:
        rows = lay_out(rows, shards)
    # The writer sorts by its partition columns anyway; with the id behind them pages have narrow bounds.
    ordered = rows.select(*INDEX_COLUMNS, "shard").sortWithinPartitions("language", "shard", "id")
    if seen is not None:
        ordered = ordered.observe(seen, F.count(F.lit(1)).alias("n"))
    filters = _FILTERS if buckets is None else _FILTERS | _HASH_FILTER
    ordered.write.options(**filters).partitionBy("language", "shard").parquet(f"{path}/rows/v={folder}")
    if buckets is not None:
        done = rows.sparkSession.read.schema(_ROWS).parquet(f"{path}/rows/v={folder}")
        bitmaps = hb.hash_bitmaps(done, buckets or hb.bucket_count(done.count()))
        bitmaps.write.parquet(f"{path}/hashes/v={folder}")
    return folder


def save_index(index: DataFrame, path: str, shards: int = 16, bitmaps: bool = False) -> int:
    """Write the whole index as a new base; returns its version.

    An index built with ``shards`` is written as it comes. ``bitmaps`` keeps bitmaps of
    the hashes, now and with each delta, for :func:`insert_absent`.
    """
    spark = index.sparkSession
    state = _state(spark, path)
    version = 0 if state is None else state[0] + 1
    folder = _write_rows(index, path, version, shards, 0 if bitmaps else None)
    _commit(spark, path, version, version, None, folder)
    return version


def append_delta(
    added: DataFrame, removed: DataFrame, path: str, token: str | None = None, shards: int = 16,
    seen: Observation | None = None,
) -> int | None:
    """Remove the paths, then add the rows, as one version.

    A ``token`` that is already committed makes the call a no-op (None), which
    is what a replayed micro-batch needs. ``seen`` counts the rows as they are written.
    """
    spark = added.sparkSession
    state = _state(spark, path)
    if state is None:
        raise FileNotFoundError(f"no index at {path}")
    if token is not None and not _commits(spark, path).where(F.col("token") == token).isEmpty():
        return None
    version = state[0] + 1
    kept = read_bitmaps(spark, path)
    folder = _write_rows(added, path, version, shards, None if kept is None else kept[1], seen)
    removed.select("filepath").distinct().write.parquet(f"{path}/removed/v={folder}")
    _commit(spark, path, version, state[1], token, folder)
    return version


def _numbered(table: DataFrame) -> DataFrame:
    """``v`` as the version that the folder's name begins with."""
    return table.withColumn("v", F.substring_index("v", "-", 1).cast("long"))


def _folders(spark: SparkSession, path: str, base: int) -> dict[int, str]:
    """Folder of each version since the last full save."""
    return {r["version"]: r["folder"] for r in _commits(spark, path).where(
        F.col("version") >= base).select("version", "folder").collect()}


def read_index(spark: SparkSession, path: str, keep_shard: bool = True) -> DataFrame:
    """The index as of the latest committed version; no index reads as empty."""
    state = _state(spark, path)
    if state is None:
        return empty_index(spark)
    _, base = state
    folders = _folders(spark, path, base)
    rows = _numbered(spark.read.schema(_ROWS).option("basePath", f"{path}/rows").parquet(
        *[f"{path}/rows/v={folder}" for _, folder in sorted(folders.items())]))
    deltas = [folder for version, folder in sorted(folders.items()) if version > base]
    if deltas:
        gone = _numbered(spark.read.schema(_REMOVED).option("basePath", f"{path}/removed").parquet(
            *[f"{path}/removed/v={folder}" for folder in deltas]))
        last = gone.groupBy("filepath").agg(F.max("v").alias("gone_at"))
        dead = (rows["filepath"] == last["filepath"]) & (rows["v"] < last["gone_at"])
        rows = rows.join(last, dead, "left_anti")
    return rows.select(*INDEX_COLUMNS, *(["shard"] if keep_shard else []))


def compact_index(spark: SparkSession, path: str, shards: int = 16) -> int:
    """Rewrite base and deltas as one new base."""
    bitmaps = read_bitmaps(spark, path) is not None
    return save_index(read_index(spark, path, keep_shard=False), path, shards, bitmaps)


def read_bitmaps(spark: SparkSession, path: str) -> tuple[DataFrame, int] | None:
    """(bitmaps of all versions since the base, their number of buckets); None if not kept.

    0 buckets: no hash is stored yet. Bits of removed rows stay set, and the number of
    buckets stays, until the index is compacted; either costs lookups, not results.
    """
    state = _state(spark, path)
    if state is None:
        return None
    folders = _folders(spark, path, state[1])
    try:
        found = spark.read.schema(_BITMAPS).parquet(*[f"{path}/hashes/v={x}" for _, x in sorted(folders.items())])
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    some = found.select("buckets").first()
    return hb.merged(found), 0 if some is None else some["buckets"]


class Inserted(NamedTuple):
    version: int | None  # None: the token was committed before
    chunks: int  # that came in
    possible: int  # distinct hashes that had to be looked up
    inserted: int


def insert_absent(chunks: DataFrame, path: str, encoder: Encoder | None = None,
                  token: str | None = None, shards: int = 16) -> Inserted:
    """Add the chunks whose hash is not stored to a saved index, as one version.

    The result is that of ``maintenance.upsert_chunks``, row for row. The chunks are
    written once and counted as they are written; the bitmaps leave few of their hashes,
    which are looked up in the index. Its rows are read where their Bloom filters
    say so, its texts and vectors never. An index without bitmaps is asked for all hashes.
    """
    spark = chunks.sparkSession
    scratch = shared_dir(spark, "insert")
    came, added = Observation(), Observation()
    try:
        chunks.observe(came, F.count(F.lit(1)).alias("n")).write.parquet(f"{scratch}/chunks")
        chunks = spark.read.schema(chunks.schema).parquet(f"{scratch}/chunks")
        kept = read_bitmaps(spark, path)
        hashes = chunks.select("text_hash").distinct() if kept is None else hb.possible_hashes(chunks, kept[0], max(1, kept[1]))
        hashes.write.parquet(f"{scratch}/possible")
        possible = spark.read.schema("text_hash string").parquet(f"{scratch}/possible")
        present = hb.stored_among(read_index(spark, path), possible)
        asked = possible.count()
        fresh = with_defaults(hb.absent_chunks(chunks, present, asked <= hb.MAX_BROADCAST_HASHES))
        if "vector" not in fresh.columns:
            fresh = embed(lay_out(fresh, shards), encoder)
        removed = spark.createDataFrame([], "filepath string")
        version = append_delta(fresh, removed, path, token, shards, added)
        return Inserted(version, came.get["n"], asked, 0 if version is None else added.get["n"])
    finally:
        remove_dir(spark, scratch)


def ensure_index(spark: SparkSession, path: str) -> bool:
    """Create an empty index with the fixed schema where there is none; tells whether it did."""
    if _state(spark, path) is not None:
        return False
    save_index(empty_index(spark), path)
    return True


def clear_index(spark: SparkSession, path: str) -> None:
    """Make the index empty; does nothing where there is none."""
    if _state(spark, path) is not None:
        save_index(empty_index(spark), path)


# Map


def save_points(points: DataFrame, path: str, method: str = "PCA") -> None:
    points.withColumn("method", F.lit(method)).write.mode("overwrite").parquet(path)


def load_points(spark: SparkSession, path: str) -> DataFrame:
    """Saved map points; FileNotFoundError when none were saved or they were cleared.

    Any other read failure is Spark's own error.
    """
    try:
        points = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no map at {path}") from None
        raise
    if points.isEmpty():
        raise FileNotFoundError(f"no map at {path}")
    return points


def points_summary(points: DataFrame) -> DataFrame:
    """The envelope of a saved map: row count and method."""
    return points.agg(F.count("*").alias("total"), F.min("method").alias("method"))


def clear_points(spark: SparkSession, path: str) -> None:
    """Leave an empty table, which reads as absent: a map has at least ten rows."""
    try:
        schema = spark.read.parquet(path).schema
    except AnalysisException:
        return
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
