"""Codes against complete scans in plain integers."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from corpusmill.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    kept = sorted(((i is None, i or 0, v, label) for i, v, label in rows
                   if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: r[:3])
    ints = [[math.floor(256 * x) for x in r[2]] for r in kept]
    width = len(ints[0]) // parts
    cut = [[tuple(v[p * width:(p + 1) * width]) for p in range(parts)] for v in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def gap(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (gap(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            members = defaultdict(list)
            for c, code in zip(cut, codes, strict=True):
                members[code[p]].append(c[p])
            for e, own in members.items():
                books[p][e] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    codes = assign()
    errors = [sum(gap(c[p], books[p][code[p]]) for p in range(parts)) for c, code in zip(cut, codes, strict=True)]
    total = defaultdict(int)
    for r, e in zip(kept, errors, strict=True):
        total[r[3]] += e
    name = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((None if r[0] else r[1], "".join(f"{x:02x}" for x in code), e, total[r[3]], name) for r, code, e in zip(kept, codes, errors, strict=True)), key=repr)


def got(df, **how):
    return sorted(map(tuple, vc.Codes(df, **how).digested().collect()), key=repr)


def vectors(n, size=32, seed=0, few=False):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25]) if few else rng.gauss(0, 0.3) for _ in range(size)], rng.choice([1, 2, 3, None])) for i in range(n)]
    return [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]


@pytest.mark.parametrize("few", [False, True])
def test_against_complete_scans(spark, few):
    rows = vectors(400, few=few)
    bad = [(1000, None, 1), (-5, [None] * 32, 1), (-4, [math.nan] + [0.0] * 31, 1), (-3, [math.inf] * 32, None), (-2, [-math.inf] * 32, None)]
    random.Random(5).shuffle(rows)
    assert got(spark.createDataFrame(rows + bad, SCHEMA)) == brute(rows)


def test_real_vectors_take_fewer_comparisons(spark, real):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in real("embeddings").collect()]
    codes = vc.Codes(real("embeddings"))
    assert sorted(map(tuple, codes.digested().collect()), key=repr) == brute(rows)
    assert codes.compared[0] == len(rows) * 16 * 64 and codes.compared[2] < codes.compared[0]


def test_only_moved_entries_are_compared():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x = rng.integers(-4, 5, (40, 3))
        old = rng.integers(-4, 5, (8, 3))
        code, error = vc.scan(x, old)
        new = old.copy()
        new[rng.random(8) < 0.3] += rng.integers(-2, 3, 3)
        moved = (new != old).any(axis=1)
        again = vc.rescan(x, new, moved, code, error)
        full = vc.scan(x, new)
        assert (again[0] == full[0]).all() and (again[1] == full[1]).all()
        stay = ~moved[code]
        assert again[2] == stay.sum() * moved.sum() + (~stay).sum() * 8


def test_large_components_are_exact():
    x = np.array([[2**27 - 1, -2**27 + 1, 5, 0]])
    assert vc.distances(x, -x)[0, 0] == sum((2 * int(v)) ** 2 for v in x[0])
    with pytest.raises(OverflowError):
        vc.integers(np.array([1e30]))


def test_few_vectors_equal_ids_and_ties(spark):
    rows = [(3, [0.5] * 16, 1), (3, [0.25] * 16, 1), (1, [0.5] * 16, None), (None, [0.0] * 16, None), (2, [0.25] * 16, 2)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", vector string, code int, errors int")
    assert got(df) == brute(rows)
    assert got(spark.createDataFrame(rows * 30, SCHEMA)) == brute(rows * 30)


def test_edges(spark):
    empty = vc.Codes(spark.createDataFrame([], SCHEMA))
    assert empty.codebooks is None and empty.digested().collect() == []
    assert empty.digested().columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert got(spark.createDataFrame([(1, None, 1), (2, [], 1)], SCHEMA)) == []
    rows = vectors(70, 16)
    assert got(spark.createDataFrame([*rows, (100, [1.0] * 8, 1), (-1, [], 1)], SCHEMA)) == brute(rows)
    with pytest.raises(ValueError):
        vc.Codes(spark.createDataFrame([(1, [1.0] * 17, 1)], SCHEMA))
    unlabelled = spark.createDataFrame([r[:2] for r in rows], "vec_id long, embedding array<double>")
    assert got(unlabelled) == brute([(i, v, None) for i, v, _ in rows])
    assert got(spark.createDataFrame(rows, SCHEMA), parts=4, entries=5, rounds=1) == brute(rows, 4, 5, 1)
