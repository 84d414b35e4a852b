"""Tree scan, decoding and path functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.sources.files import list_tree, load_tree, read_files, scan_files


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "build"
    for path, content in {
        "src/app.ts": b"const a = 1;\r\nconst b = 2;\rconst c = 3;\n",
        "src/ui/View.tsx": b"x\xff\xfe y",
        "main.go": "package main // é".encode(),
        "__tests__/_unit.ts": b"test",
        ".github/hook.go": b"package hook",
        "we'ird %dir_/a b.ts": b"odd",
        "src/LOUD.TS": b"skipped",
        "readme.md": b"skipped",
        ".ts": b"skipped",
        "node_modules/lib/index.ts": b"skipped",
        "src/dist/out.ts": b"skipped",
        ".git/x.go": b"skipped",
    }.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)
    return root


def test_many_files_are_listed_and_read_by_many_tasks(spark, tmp_path):
    for i in range(240):
        (tmp_path / f"d{i % 60}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 60}" / f"f{i}.ts").write_text(f"const a = {i};")
    listed = list_tree(spark, str(tmp_path))
    tasks = listed.select(F.spark_partition_id().alias("p")).distinct().count()
    read = read_files(listed)
    assert tasks >= 4 and read.select(F.spark_partition_id()).distinct().count() >= 4
    assert read.count() == 240


def test_load_tree(spark, tree):
    rows = {r.filepath: r for r in load_tree(spark, str(tree)).collect()}
    below = {p.removeprefix(f"{tree}/"): r for p, r in rows.items()}
    assert set(below) == {
        "src/app.ts", "src/ui/View.tsx", "main.go", "__tests__/_unit.ts",
        ".github/hook.go", "we'ird %dir_/a b.ts"}
    assert below["src/app.ts"].content == "const a = 1;\nconst b = 2;\nconst c = 3;\n"
    assert below["src/ui/View.tsx"].content == b"x\xff\xfe y".decode("utf-8", "replace")
    assert below["main.go"].language == "go"
    assert below["src/ui/View.tsx"].language == "typescript"


def test_scan_files_agrees_with_the_tree(spark, tree):
    every = [(str(p), "") for p in tree.rglob("*") if p.is_file()]
    table = spark.createDataFrame(every, "filepath string, content string")
    scanned = {r.filepath for r in scan_files(table, str(tree)).collect()}
    assert scanned == {r.filepath for r in list_tree(spark, str(tree)).collect()}


def test_missing_root_and_unreadable_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        list_tree(spark, str(tmp_path / "none"))
    gone = spark.createDataFrame([(str(tmp_path / "gone.ts"),)], "filepath string")
    assert read_files(gone).count() == 0


def test_path_functions(spark):
    rows = spark.createDataFrame(
        [("a\\b\\c\\d.ts",), ("c/d.go",), ("x.tsx",), ("a/.ts",), ("a.b/c",), ("q.d.ts",)], "p string")
    got = {r.p: (r.n, r.s, r.l) for r in rows.select(
        "p", tx.normalize_path(F.col("p")).alias("n"), tx.short_path(F.col("p")).alias("s"),
        tx.language_of(F.col("p")).alias("l")).collect()}
    assert got == {
        "a\\b\\c\\d.ts": ("a/b/c/d.ts", "b/c/d.ts", "typescript"),
        "c/d.go": ("c/d.go", "c/d.go", "go"),
        "x.tsx": ("x.tsx", "x.tsx", "typescript"),
        "a/.ts": ("a/.ts", "a/.ts", None),
        "a.b/c": ("a.b/c", "a.b/c", None),
        "q.d.ts": ("q.d.ts", "q.d.ts", "typescript"),
    }
