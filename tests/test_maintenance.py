"""Dedup, upsert, delete, change detection and refresh."""

from __future__ import annotations

import pytest

from corpusmill.operators import maintenance as m
from corpusmill.operators.chunking import chunk_documents
from corpusmill.operators.embedding import hashed
from corpusmill.schema import INDEX

ENC = hashed(8)


def keys(df):
    return sorted(tuple(r) for r in df.select(
        "id", "filepath", "start_line", "end_line", "text_hash").collect())


def text(tag, lines=60):
    return "\n".join(f"{tag} line {i} with some words in it" for i in range(lines))


A = {"a.ts": text("one"), "a.tsx": text("two"), "b.go": text("three", 3), "it's.ts": text("four", 5)}


def test_build_is_refresh_neutral(files):
    index = m.build_index(files(A), ENC)
    for mode in ("compat", "strict"):
        assert keys(m.refresh_index(index, files(A), ENC, mode)) == keys(index)


def test_upsert_twice_is_upsert_once(files):
    chunks = chunk_documents(files(A))
    once = m.upsert_chunks(m.empty_index(chunks.sparkSession), chunks, ENC)
    assert keys(m.upsert_chunks(once, chunks, ENC)) == keys(once)
    assert once.schema.fieldNames() == INDEX.fieldNames()


def test_append_build_keeps_old_rows(files):
    old = m.build_index(files(A), ENC)
    grown = m.build_index(files({"a.ts": text("new")}), ENC, append_to=old)
    assert set(keys(old)) < set(keys(grown))


def test_refresh_modes(files):
    index = m.build_index(files(A), ENC)
    lines = A["a.ts"].split("\n")
    shifted = "// top\n" + A["a.tsx"]
    after = {"a.ts": "\n".join(lines + ["one more line of the file, edited"]),
             "a.tsx": shifted, "new.go": text("five", 4)}
    strict = m.refresh_index(index, files(after), ENC, "strict")
    assert keys(strict) == keys(m.build_index(files(after), ENC))
    compat = m.refresh_index(index, files(after), ENC, "compat")
    paths = {r.filepath for r in compat.collect()}
    # Vanished files stay in compat mode.
    assert paths == {"a.ts", "a.tsx", "new.go", "b.go", "it's.ts"}
    assert {r.filepath for r in m.changed_files(index, chunk_documents(files(after))).collect()} == {
        "a.ts", "a.tsx", "new.go"}


def test_pure_removal_is_seen_by_strict_only(files):
    head = "\n".join(["h" * 100] * 13 + ["h" * 180])
    index = m.build_index(files({"x.ts": head + "\n" + "\n".join(["t" * 100] * 5)}), ENC)
    assert index.count() == 2
    # Still over the bound, so the head stays the same piece and the tail is dropped.
    after = {"x.ts": head + "\n" + "t" * 20}
    new = chunk_documents(files(after))
    assert m.changed_files(index, new).count() == 0
    assert m.refresh_index(index, files(after), ENC, "compat").count() == 2
    assert m.refresh_index(index, files(after), ENC, "strict").count() == 1


def test_unknown_mode(files):
    with pytest.raises(ValueError):
        m.refresh_index(m.build_index(files(A), ENC), files(A), ENC, "other")


def test_delete_is_exact(files, spark):
    index = m.build_index(files(A), ENC)
    paths = spark.createDataFrame([("a.ts",), ("it's.ts",), ("none.ts",)], "filepath string")
    left = {r.filepath for r in m.delete_by_filepath(index, paths).collect()}
    assert left == {"a.tsx", "b.go"}
    gone = index.where("filepath in ('a.ts', 'it''s.ts')").count()
    assert m.deleted_count(index, paths).first().deleted == gone > 0


def rows(spark, *values):
    return spark.createDataFrame(
        [(f"i{n}", "t", *v) for n, v in enumerate(values)],
        "id string, text string, filepath string, start_line int, end_line int, "
        "node_type string, language string, text_hash string")


def test_dedup_first_wins_under_a_hot_hash(spark):
    values = [(f"f{n:04d}", 1, 2, "d", "go", "hot") for n in range(999, -1, -1)]
    values += [("z", 5, 6, "d", "go", "cold"), ("z", 3, 4, "d", "go", "cold")]
    got = {r.text_hash: (r.filepath, r.start_line) for r in m.dedup_chunks(rows(spark, *values)).collect()}
    assert got == {"hot": ("f0000", 1), "cold": ("z", 3)}


def test_dedup_prunes_before_the_exchange(spark):
    plan = m.dedup_chunks(rows(spark, ("f", 1, 2, "d", "go", "h")))._jdf.queryExecution().toString()
    physical = plan[plan.index("Physical Plan"):]
    assert "WindowGroupLimit" in physical[physical.index("Exchange"):]


def test_summaries(spark, files):
    stored = rows(spark, ("f", 1, 2, "d", "go", "h1"))
    new = rows(spark, ("f", 1, 2, "d", "go", "h1"), ("g", 1, 2, "d", "go", "h2"),
               ("g", 3, 4, "d", "go", "h2"))
    row = m.build_summary(stored, new).first()
    assert (row.files, row.chunks, row.upserted) == (2, 3, 1)
    row = m.refresh_summary(stored, new).first()
    assert (row.files_updated, row.chunks, row.upserted) == (1, 2, 1)


def test_missing_metadata_gets_defaults(spark):
    row = m.with_defaults(rows(spark, (None, None, None, None, None, "h"))).first()
    assert (row.filepath, row.start_line, row.end_line, row.node_type, row.language) == ("", 0, 0, "", "")
