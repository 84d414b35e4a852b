"""Removed bytes against a table of all strings."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from corpusmill.llm import repeats
from corpusmill.llm.repeats import Repeats
from corpusmill.llm.run_index import RunIndex


def brute(rows, length=50):
    seen: dict[bytes, int] = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            if doc is not None:
                w = data[i:i + length]
                seen[w] = min(seen.get(w, doc), doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if doc is not None and seen[data[i:i + length]] < doc:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(data)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in Repeats(df).digest().collect()), key=repr)


def corpus(seed: int, n: int = 60):
    rng = random.Random(seed)
    letters = "abé \n"
    shared = ["".join(rng.choice(letters) for _ in range(rng.randint(40, 160))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.6:
                s = rng.choice(shared)
                a = rng.randrange(len(s) // 2)
                parts.append(s[a:a + rng.randint(30, 150)])
            else:
                parts.append("".join(rng.choice(letters) for _ in range(rng.randint(0, 90))))
        rows.append((rng.randrange(2 * n), "".join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(docs, seed):
    rows = corpus(seed)
    assert result(docs(rows)) == brute(rows)


def test_common_anchors_are_split_by_window(docs):
    """A phrase in more documents than an index takes goes the exact way for common anchors."""
    rows = corpus(4) + [(1000 + i, "z%04d" % i + "the same phrase in all of the documents, longer than fifty bytes" + "%04dq" % i) for i in range(90)]
    assert result(docs(rows)) == brute(rows)


def test_real_documents(real):
    rows = [(r.doc_id, r.text) for r in real("documents").collect()]
    assert result(real("documents").select("doc_id", "text")) == brute(rows)


def test_edges(docs):
    line = "x" * 30 + "0123456789" * 5
    rows = [(2, line), (1, line), (1, line), (None, line), (3, None), (4, ""), (5, line[:49]), (6, "é" * 60), (7, "é" * 60 + "a")]
    df = docs(rows, clash=("batch", "payload", "bucket"))
    assert result(df) == brute(rows)
    cleaned = {(r.doc_id, r.text) for r in Repeats(df).cleaned().collect()}
    assert cleaned == {(2, ""), (1, line), (None, line), (3, None), (4, ""), (5, line[:49]), (6, "é" * 60), (7, "a")}
    assert {tuple(r) for r in Repeats(df).spans().collect()} == {(2, 0, 80), (7, 0, 120)}
    assert Repeats(df).cleaned().columns == df.columns


def test_empty_table(docs):
    assert result(docs([])) == []


def test_long_text_crosses_pieces(docs):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh ") for _ in range(400_000))
    rows = [(1, text), (2, "start" + text[100_000:300_000] + "end"), (3, text[50:])]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in Repeats(docs(rows)).digest().collect()}
    assert got == {1: (0, 0), 2: (200_000, 1), 3: (len(text) - 50, 1)}


@pytest.mark.parametrize("seed", range(5))
def test_run_index_marks(seed):
    rng = random.Random(seed)
    for _ in range(30):
        length = rng.choice([7, 8, 12])
        base = "".join(rng.choice("ab") for _ in range(60))
        strings = []
        for _ in range(rng.randint(1, 10)):
            a = rng.randint(0, 30)
            strings.append(base[a:a + rng.randint(length, length + 25)])
        ids = np.array([rng.randint(0, 5) for _ in strings])
        index = RunIndex([np.frombuffer(s.encode(), np.uint8) for s in strings], ids, length)
        for i, (s, found) in enumerate(zip(strings, index.marks(ids, length), strict=True)):
            assert list(found) == [any(ids[j] < ids[i] and s[a:a + length] in t for j, t in enumerate(strings)) for a in range(len(s) - length + 1)]
        assert len(index.run_start) <= sum(map(len, strings)) + len(strings)


def test_units_cover_every_window():
    data = np.frombuffer(("the quick brown fox " * 40).encode(), np.uint8)
    offsets = np.array([0, 300, 320, len(data)])
    a, b, *_ = repeats.units(data, offsets, np.ones(3, bool), 50)
    covered = [s for x, y in zip(a, b, strict=True) for s in range(x, y + 1)]
    assert covered == [*range(251), *range(320, len(data) - 49)]
