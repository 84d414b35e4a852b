"""Near duplicates against all pairs."""

from __future__ import annotations

import random
import re

import pytest

from corpusmill.llm.components import components
from corpusmill.llm.minhash import near_duplicates


def brute(rows, size, threshold=80):
    sets: dict = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        k = min(size, len(words))
        sets.setdefault(doc, []).append({tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if words else set())
    root = {d: d for d in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(root)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= threshold * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in root}


def corpus(seed: int, n: int):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(words) for _ in range(rng.randint(1, 120))] for _ in range(max(2, n // 8))]
    rows = []
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i * 3, rng.choice([" ", "\n", "  "]).join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,size", [(1, 4), (2, 5)])
def test_components_match_all_pairs(docs, seed, size):
    rows = corpus(seed, 150)
    got = {r.doc_id: r for r in near_duplicates(docs(rows), shingle=size).collect()}
    want = brute(rows, size)
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_one_large_group_in_blocks(docs):
    """Copies of a text that differ enough from each other to need more than one head."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(120):
        text = list(base)
        for k in rng.sample(range(100), 2):
            text[k] = f"x{i}_{k}"
        rows.append((i, " ".join(text)))
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(rows), shingle=4, block=16).collect()}
    assert got == brute(rows, 4)


def test_edges(docs):
    rows = [(5, None), (6, ""), (7, " \n "), (8, "One two"), (9, "one TWO"), (None, "one two"), (3, "a b c d e f"), (3, "a b c d e f"),
            (4, "a b c d e f"), (10, "two one")]
    got = near_duplicates(docs(rows, clash=("component_id", "kept", "node", "band")), shingle=4).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by[d].component_id for d in (5, 6, 7, 8, 9, 3, 4, 10)] == [5, 6, 7, 8, 8, 3, 3, 10]
    assert [by[d].n_shingles for d in (5, 6, 7, 8, 3)] == [0, 0, 0, 1, 3]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_empty_table(docs):
    assert near_duplicates(docs([])).collect() == []


def test_long_text(docs):
    text = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, text), (2, text + " more words at the end"), (3, text[: len(text) // 2])]
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_node_that_heads_its_keys_and_no_best_pair(docs):
    """Two edits of a text that share no band with each other, each with the text: all three belong together.

    The seeds are families whose text shares as many or more bands with the first edit,
    so the second, the least of all its keys, is in nobody's best pair.
    """
    rows = []
    for seed in (816, 2443, 3328, 3438, 3636, 4175, 4998, 5209, 6865, 7371, 8411):
        rng = random.Random(seed)
        base = [f"w{rng.randrange(10**6)}" for _ in range(94)]
        for _ in range(2):
            text = list(base)
            for k in rng.sample(range(94), 2):
                text[k] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
        rows.append((len(rows), " ".join(base)))
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(rows)).collect()}
    assert got == brute(rows, 5) == {i: i - i % 3 for i in range(len(rows))}
