from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from corpusmill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="corpusmill-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files(spark):
    """Build a files table from {path: content}."""
    from corpusmill.functions import text as tx
    from pyspark.sql import functions as F

    def make(contents: dict[str, str]):
        df = spark.createDataFrame(
            list(contents.items()), "filepath string, content string")
        return df.select("filepath", tx.language_of(F.col("filepath")).alias("language"), "content")

    return make
