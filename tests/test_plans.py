"""Physical plans: what is shuffled, what reaches the scan, what runs in Python."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import lookup, maintenance, reports, search
from corpusmill.operators.chunking import chunk_documents
from corpusmill.operators.declarations import chunk_code
from corpusmill.operators.embedding import hashed
from corpusmill.sources import snapshots
from corpusmill.sources.files import scan_files

ROOT = Path(__file__).resolve().parent.parent


def plan(df) -> str:
    text = df._jdf.queryExecution().toString()
    return text[text.index("Physical Plan"):]


@pytest.fixture(scope="module")
def stored(spark, files, tmp_path_factory):
    base = tmp_path_factory.mktemp("plans")
    contents = {f"src/f{i}.{'go' if i % 2 else 'ts'}": f"line {i} of words\n" * 20 for i in range(40)}
    table = files(contents)
    table.write.parquet(str(base / "files"))
    snapshots.save_index(maintenance.build_index(table, hashed(16)), str(base / "index"))
    return spark.read.parquet(str(base / "files")), snapshots.read_index(spark, str(base / "index"))


def test_scan_and_chunking_are_narrow(stored):
    table, _ = stored
    text = plan(chunk_documents(scan_files(table, "src")))
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text


def test_declarations_are_cut_where_the_file_is(stored):
    table, _ = stored
    text = plan(chunk_code(table))
    assert text.count("MapInArrow") == 1
    assert not any(step in text for step in ("Exchange", "Window", "Sort", "ArrowEvalPython"))


def test_reports_read_their_columns(stored):
    _, index = stored
    for df, columns in (
        (reports.file_stats(index), "filepath:string"),
        (reports.index_stats(index), "node_type:string"),
        (lookup.project_scan(index, "filepath"), "filepath:string"),
        (reports.index_status(index), ""),
    ):
        assert f"ReadSchema: struct<{columns}>" in plan(df)


def test_path_filters_reach_the_scan(stored):
    _, index = stored
    assert "StringContains(filepath,auth)" in plan(lookup.path_search(index, "auth"))
    assert "EqualTo(filepath,a.ts)" in plan(lookup.file_chunks(index, "a.ts"))
    assert "TakeOrderedAndProject" in plan(lookup.path_search(index, "auth"))


def test_search_reads_narrow_columns_and_pruned_partitions(stored, spark):
    _, index = stored
    asked = spark.createDataFrame(
        [(1, [1.0] * 16, "go")], "query_id bigint, qvec array<float>, language string")
    text = plan(search.knn_search(index, asked, 3, with_rows=False))
    assert "ReadSchema: struct<id:string,vector:array<float>>" in text
    assert "language" in text[text.index("PartitionFilters"):][:200]


def test_upsert_shuffles_the_new_rows_once(stored, files):
    _, index = stored
    chunks = chunk_documents(files({"a.ts": "x" * 50})).select("*")
    text = plan(maintenance.new_chunks(index, chunks).hint("merge"))
    joined = text[text.index("LeftAnti"):]
    assert joined.count("Exchange hashpartitioning(text_hash") <= 2


def test_vectors_are_not_shuffled_by_a_sharded_build(files):
    index = maintenance.build_index(files({"a.ts": "x" * 50}), hashed(16), shards=4)
    text = plan(index)
    assert "REBALANCE_PARTITIONS_BY_COL" in text
    assert text.index("ArrowEvalPython") < text.index("Exchange")


def test_deleted_paths_are_not_hinted(stored, spark):
    _, index = stored
    paths = index.select("filepath").where(F.col("filepath").contains("f1"))
    assert "Hint" not in plan(maintenance.delete_by_filepath(index, paths))


def test_tasks_run_from_any_directory(tmp_path):
    """Python workers do not need the package on their path."""
    script = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as entry
from corpusmill.session import local_session
print("rows", entry.entry(local_session(2)).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True,
        text=True, timeout=300)
    assert "rows 320" in done.stdout, done.stderr[-2000:]


@pytest.mark.parametrize("mode,columns", [("compat", "filepath:string,text_hash:string"), ("strict", "id:string,filepath:string")])
def test_refresh_chunks_files_once_and_leaves_stored_texts_in_place(stored, mode, columns):
    table, index = stored
    calls = []

    def chunker(files):
        calls.append(1)
        return chunk_documents(files)

    edited = table.withColumn("content", F.when(F.col("filepath").contains("f3"), F.concat("content", F.lit("more\n" * 20))).otherwise(F.col("content")))
    refreshed = maintenance.refresh_index(index, edited, hashed(16), mode, chunker)
    rows = refreshed.collect()
    assert len(rows) == index.count() and all(len(r.vector) == 16 for r in rows) and calls == [1]
    text = refreshed._jdf.queryExecution().executedPlan().toString()
    text = text[:text.index("Initial Plan")] if "Initial Plan" in text else text
    assert f"ReadSchema: struct<{columns}>" in text  # what the comparison reads of the stored side
    assert "content" not in text  # the files are not read again
    # The rows that stay meet the replaced paths where they are.
    kept = text[:text.index("ArrowEvalPython")]
    assert "BroadcastHashJoin" in kept and "LeftAnti" in kept
