from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """A documents table from rows (doc_id, text[, lang[, source]])."""

    def make(rows, clash: tuple[str, ...] = ()):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        from pyspark.sql import functions as F
        return df.withColumns({name: F.lit("other") for name in clash}) if clash else df

    return make


@pytest.fixture(scope="session")
def real(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
