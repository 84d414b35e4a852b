"""Session helper for local runs and the shared scratch folder lookup."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", memory: str = "8g", app: str = "corpusmill") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    partitions = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call sites in error messages cost a round trip per Column operation.
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``.

    The cluster names a folder every executor can reach in that setting. Only
    where it is unset in a session on one machine is a temporary folder used; on
    any other master that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        return tempfile.mkdtemp(prefix=f"corpusmill-{label}-")
    return f"{base.rstrip('/')}/corpusmill/{label}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder of :func:`shared_dir` with all it holds."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Set a checkpoint folder only where the session has none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark, "checkpoint"))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for CPU-heavy work on an input of very few scan tasks.

    Looks at the planned scan only, runs nothing; an input that already has a
    task per core, as any large one does, passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
