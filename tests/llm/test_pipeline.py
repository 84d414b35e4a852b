"""The pipeline's stages in order, each against what it should keep."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from corpusmill.llm.tables import written


def test_stages_and_columns(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, n = df.columns, df.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "decontamination", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        df = written(stage(spark, df, "/root/testdata/sf0.001"), "test-stage")
        assert df.columns[:len(columns)] == columns and (df.columns == columns or name == "mixing")
        if name != "mixing":
            assert 0 < df.count() <= n
            n = df.count()


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """English prose with exact and near copies, a repeated passage, a leak and rows without a language."""
    rng = random.Random(7)
    source = " ".join(r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en'").limit(60).collect()).split()
    prose = lambda n: " ".join(rng.choice(source) for _ in range(n))
    rows = [(i, prose(120)) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    rows += [(200 + i, rows[i][1] + " ending") for i in range(10, 15)]
    passage = prose(70)
    rows += [(300 + i, f"{prose(100)}\n{passage}\n{prose(100)}") for i in range(3)]
    item = prose(40)
    rows += [(400, f"{prose(80)} {item} {prose(80)}")]
    rows += [(500, "123 456 !!"), (501, None), (502, "")]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(d, t, "en" if d % 2 else "fr" if d == 500 else "en", f"src{d % 3}", len(t or "")) for d, t in rows],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(rows), passage


def test_planted_cases(spark, planted):
    folder, texts, passage = planted
    df = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        df = written(stage(spark, df, folder), "test-planted")
        seen[name] = {r.doc_id: r.text for r in df.collect()}
    clean = set(range(60)) | {300, 301, 302}
    assert set(seen["language_id"]) == set(texts) - {500, 501, 502}
    assert set(seen["near_dedup"]) == clean | {400}
    cut = seen["suffix_dedup"]
    assert passage in cut[300] and all(passage not in cut[d] and len(cut[d]) < len(texts[d]) - len(passage) + 10 for d in (301, 302))
    assert all(cut[d] == texts[d] for d in range(60))
    assert set(seen["decontamination"]) == clean
    assert set(seen["mixing"]) <= clean and len(seen["mixing"]) > 30


def test_run_gives_the_mix(spark, planted):
    found = corpus_pipeline.run(spark, planted[0])
    assert {"mix_epoch", "mix_shard"} <= set(found.columns) and found.count() > 40


def test_empty_input(spark, planted):
    df = spark.read.parquet(f"{planted[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        df = written(stage(spark, df, planted[0]), "test-empty")
    assert df.count() == 0
