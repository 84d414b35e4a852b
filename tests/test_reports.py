"""Reports and lookups on small index rows."""

from __future__ import annotations

import pytest

from corpusmill.operators import lookup, reports
from corpusmill.operators.projection import map_legend, map_points

ROWS = [
    ("src/main.go", "go", "function_declaration", "func main() {}", 1, 5, "abc"),
    ("src/app.ts", "typescript", "class_declaration", "class App {}", 1, 10, "def"),
]


@pytest.fixture(scope="module")
def make(spark):
    def build(rows):
        return spark.createDataFrame(
            [(f"i{n}", *r) for n, r in enumerate(rows)],
            "id string, filepath string, language string, node_type string, text string, "
            "start_line int, end_line int, text_hash string")
    return build


def test_totals_and_breakdown(make):
    index = make(ROWS)
    assert tuple(reports.index_totals(index).first()) == (2, 2)
    got = {(r.dimension, r.value): r.chunks for r in reports.index_stats(index).collect()}
    assert got == {
        ("language", "go"): 1, ("language", "typescript"): 1,
        ("node_type", "function_declaration"): 1, ("node_type", "class_declaration"): 1,
        ("total", "all"): 2}
    assert reports.index_status(index).first().total_chunks == 2
    assert reports.index_status(index.limit(0)).first().total_chunks == 0


def test_missing_names_count_as_unknown(make):
    index = make([("a", None, "", "t", 1, 1, "h"), ("a", "", None, "t", 1, 1, "i")])
    got = {(r.dimension, r.value): r.chunks for r in reports.index_stats(index).collect()}
    assert got[("language", "unknown")] == got[("node_type", "unknown")] == 2
    assert reports.file_stats(index).first().language == ""


def test_file_list(make):
    index = make([*ROWS, ("src/app.ts", "typescript", "x", "t", 11, 12, "ghi"),
                  ("Deep/er/src/App.ts", "typescript", "x", "t", 1, 2, "jkl")])
    files = reports.file_stats(index)
    top = reports.file_stats_top(files).collect()
    assert [(r.filepath, r.chunk_count) for r in top] == [
        ("src/app.ts", 2), ("Deep/er/src/App.ts", 1), ("src/main.go", 1)]
    assert reports.file_stats_top(files, ascending=True, n=1).first().chunk_count == 1
    assert {r.short_filepath for r in top} == {"src/app.ts", "er/src/App.ts", "src/main.go"}
    assert reports.file_filter(files, "APP").count() == 2
    assert reports.file_filter(files, "").count() == 3
    assert [r.node_type for r in reports.top_node_types(index, 1).collect()] == ["x"]


def test_path_lookups_treat_wildcards_apart(make):
    index = make([("a_b/x.ts", "typescript", "d", "t", 1, 1, "1"), ("aXb/x.tsx", "typescript", "d", "t", 1, 1, "2"),
                  ("it's/100%.go", "go", "d", "t", 1, 1, "3")])

    def paths(df):
        return [r.filepath for r in df.collect()]

    assert paths(lookup.path_search(index, "a_b")) == ["a_b/x.ts"]
    assert sorted(paths(lookup.path_like(index, "a_b"))) == ["aXb/x.tsx", "a_b/x.ts"]
    assert paths(lookup.path_search(index, "'s/100%")) == ["it's/100%.go"]
    assert paths(lookup.path_search(index, "A_B")) == []
    assert paths(lookup.file_chunks(index, "a_b\\x.ts")) == ["a_b/x.ts"]
    assert sorted(paths(lookup.file_chunks(index, "b/x.ts", partial=True))) == ["aXb/x.tsx", "a_b/x.ts"]
    assert len(paths(lookup.path_search(index, "x", 1))) == 1
    with pytest.raises(ValueError):
        lookup.path_search(index, "x", 0)


def test_snippets(make):
    row = reports.snippets(make([("a/b/c/d.ts", "go", "d", "x\ny" * 100, 3, 4, "h")])).first()
    assert (row.short_filepath, len(row.snippet), len(row.hover)) == ("b/c/d.ts", 120, 80)
    assert "\n" not in row.snippet


def test_map_points_and_legend(make):
    from pyspark.sql import functions as F

    points = map_points(make([*ROWS, (None, None, "x", None, None, None, "h")]).withColumns(
        {"x": F.lit(0.1), "y": F.lit(0.2)}))
    assert points.columns == [
        "x", "y", "filepath", "short_filepath", "language", "node_type", "start_line", "snippet"]
    legend = {r.color: r.points for r in map_legend(points).collect()}
    assert legend == {"go": 1, "typescript": 1, "unknown": 1}
    assert map_legend(points, "node_type").count() == 3
