"""Line packing, size bounds and hashing."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.operators.chunking import chunk_documents, packed_pieces, split_long


def brute_pieces(code, max_chars, min_chars):
    """The packing contract, spelled out line by line."""
    out, first, buffer = [], 0, []
    for number, line in enumerate(code.split("\n")):
        if len("\n".join([*buffer, line])) < max_chars:
            buffer.append(line)
            continue
        if buffer:
            out.append((first, buffer))
            first, buffer = number, [line]
        else:
            out.append((number, [line]))
            first = number + 1
    if buffer:
        out.append((first, buffer))
    texts = [(s, len(b), "\n".join(b)) for s, b in out]
    return [p for p in texts if len(p[2]) >= min_chars]


def spark_pieces(spark, codes, max_chars, min_chars):
    df = spark.createDataFrame(list(enumerate(codes)), "n int, code string").coalesce(1)
    rows = df.select("n", packed_pieces(F.col("code"), max_chars, min_chars).alias("p")).collect()
    return {r.n: [(p.start, p.lines, p.code) for p in r.p] for r in rows}


CASES = {
    "exact 1500": "x" * 1500,
    "one below": "x" * 1499,
    "first": "x" * 1600 + "\n" + "a" * 40 + "\n" + "b" * 40,
    "middle": "a" * 40 + "\n" + "x" * 1600 + "\n" + "b" * 40,
    "last": "a" * 40 + "\n" + "x" * 1600,
    "two long": "x" * 1500 + "\n" + "y" * 1500,
    "short tail": "\n".join(["a" * 100] * 15) + "\nend",
    "many": "\n".join("line %d %s" % (i, "z" * (i % 90)) for i in range(200)),
    "empty": "",
    "blank lines": "\n" * 40,
    "accents": "é" * 700 + "\n" + "ü" * 798 + "\n" + "ß" * 60,
    "quotes": "it's 100% \\ fine_\n" * 120,
}


def test_packing_matches_the_contract(spark):
    names = list(CASES)
    got = spark_pieces(spark, [CASES[n] for n in names], 1500, 30)
    for number, name in enumerate(names):
        assert got[number] == brute_pieces(CASES[name], 1500, 30), name


@settings(max_examples=6, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text("ab é\\'", max_size=14), max_size=25), min_size=20, max_size=40))
def test_packing_property(spark, docs):
    codes = ["\n".join(lines) for lines in docs]
    got = spark_pieces(spark, codes, 20, 3)
    for number, code in enumerate(codes):
        assert got[number] == brute_pieces(code, 20, 3)
        lines = code.split("\n")
        spans = [(s, s + n) for s, n, _ in got[number]]
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        assert all("\n".join(lines[s:s + n]) == text for s, n, text in got[number])


def test_chunk_bounds_look_at_header_and_code(spark, files):
    header = len("// File: a.ts\n")
    out = chunk_documents(files({
        "a.ts": "x" * (1500 - header),
        "b.ts": "y" * (1501 - header),
        "c.ts": "z" * (1490 - 200) + "\n" + "z" * 199,
        "d.ts": "s" * (29 - header),
        "e.ts": "t" * (30 - header),
        "f.ts": "",
        "g.md": "not a source file, whatever its length is",
    })).collect()
    rows = {r.filepath: r for r in out}
    assert sorted(rows) == ["a.ts", "b.ts", "c.ts", "e.ts"]
    # Over the bound with the header, but one piece by its code: text may exceed it.
    assert len(rows["c.ts"].text) == header + 1490
    assert (rows["c.ts"].start_line, rows["c.ts"].end_line) == (1, 2)


def test_hash_and_id(spark, files):
    row = chunk_documents(files({"src\\a.ts": "const answer = 42; // it's 100%"})).first()
    text = "// File: src/a.ts\nconst answer = 42; // it's 100%"
    assert row.text == text
    assert row.text_hash == hashlib.md5(text.encode()).hexdigest()
    assert row.id == hashlib.md5(f"{row.text_hash}|1|1|document".encode()).hexdigest()


def test_split_long_keeps_line_numbers(spark):
    nodes = spark.createDataFrame(
        [("a.go", "go", "function_declaration", 11, "\n".join(["v" * 99] * 40))],
        "filepath string, language string, node_type string, start_line int, code string")
    spans = sorted((r.start_line, r.end_line) for r in split_long(nodes).collect())
    # 15 lines of 99 and 14 newlines are 1499 characters.
    assert spans == [(11, 25), (26, 40), (41, 50)]


@pytest.mark.parametrize("lines", [3000])
def test_large_file_is_cut_without_copying_it(spark, files, lines):
    code = "\n".join("entry %05d %s" % (i, "w" * 40) for i in range(lines))
    rows = chunk_documents(files({"big.ts": code})).collect()
    joined = "\n".join(
        r.text.split("\n", 1)[1] for r in sorted(rows, key=lambda r: r.start_line))
    assert joined == code
