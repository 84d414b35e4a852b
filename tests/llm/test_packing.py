"""Pieces give every document back; the curve keeps neighbours together."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from tokenizers import Tokenizer

from corpusmill.llm import packing, queries

POOL = [" ", " ", "a", "word", "'s", "\n", "  ", "\t", "é", "12", "!!", " ", " ", "<|endoftext|>", "🙂", "\x1c", "中文", ". ", "\r\n"]


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(packing.VOCABULARY)
    found.encode_special_tokens = True
    return found


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(packing._read(packing.VOCABULARY))


def whole(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]


def test_ids_are_those_of_tokenizers(tokenizer, encoder, real):
    rng = random.Random(1)
    texts = ["".join(rng.choices(POOL, k=rng.randint(0, 25))) for _ in range(4000)]
    texts += [r.text for r in real("documents").collect()]
    texts += [" " * 300_000, "a" + "\n" * 25_000 + "b", "x" * 200_000, "-=" * 50_000]
    for text in texts:
        assert encoder.encode(text).tolist() == whole(tokenizer, text)[:-1], text[:100]


def test_ids_must_follow_the_merges(tokenizer):
    import json
    data = json.loads(packing._read(packing.VOCABULARY))
    data["model"]["merges"].reverse()
    with pytest.raises(ValueError):
        packing.Encoder(json.dumps(data))


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_by_neighbours(dims, bits):
    points = np.array(list(product(range(1 << bits), repeat=dims)))
    keys = packing.hilbert(points, bits)
    assert sorted(keys) == list(range(1 << dims * bits))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_sequences_are_full_or_powers_of_two():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.randint(1, rng.choice([3, 50])) for _ in range(rng.randint(0, 30))]
        stream = [(k, np.arange(n)) for k, n in enumerate(sizes)]
        found = list(packing.fill(iter(stream), 16))
        filled = [sum(len(p[2]) for p in s) for s in found]
        full = sum(sizes) // 16
        assert filled[:full] == [16] * full
        assert sorted(filled[full:], reverse=True) == filled[full:] and len(set(filled[full:])) == len(filled[full:])
        assert all(n & (n - 1) == 0 for n in filled[full:]) and sum(filled) == sum(sizes)
        pieces = [p for s in found for p in s]
        assert [(d, i) for d, start, ids, _ in pieces for i in ids] == [(k, i) for k, n in enumerate(sizes) for i in range(n)]
        assert all(len(ids) and ids[0] == start for _, start, ids, _ in pieces)


def check(tokenizer, rows, pieces, length=packing.LENGTH):
    """Every id of every document in exactly one piece; sequences without gaps."""
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at and size > 0
            at += size
        assert at == length or at < length and at & (at - 1) == 0
    left = Counter()
    for doc, text in rows:
        left[doc, tuple(whole(tokenizer, text))] += 1
    parts = defaultdict(list)
    for p in pieces:
        parts[p.doc_id].append(p)
    texts = defaultdict(list)
    for (doc, ids), n in left.items():
        texts[doc] += [ids] * n
    for doc, owned in texts.items():
        assert sum(p.length for p in parts[doc]) == sum(map(len, owned))
        if len(owned) == 1:
            ids = np.array(owned[0], "<u4")
            own = sorted(parts[doc], key=lambda p: p.start)
            assert [p.start for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
            for p in own:
                assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes()) and p.doc_tokens == len(ids)
    assert set(parts) == set(texts)


def test_query_gives_all_documents_back(spark, real, tokenizer):
    rows = [(r.doc_id, r.text) for r in real("documents").collect()]
    result = queries.op11_curve_packing(spark, "/root/testdata/sf0.001")
    assert result.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check(tokenizer, rows, result.collect())


def test_edges(docs, tokenizer):
    assert packing.pack(docs([])).collect() == []
    rows = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "no id"), (None, None), (5, "long word " * 30_000), (6, "same"), (7, "same"), (8, " ")]
    df = docs(rows, clash=("row", "key", "ids", "tokens", "c0"))
    pieces = packing.pack(df, length=64).collect()
    check(tokenizer, rows, pieces, 64)
    for p in pieces:
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length


def test_one_text_for_all(docs, tokenizer):
    rows = [(k, "the very same words in every document") for k in range(700)]
    check(tokenizer, rows, packing.pack(docs(rows).repartition(8), length=32).collect(), 32)


def test_neighbours_share_sequences(docs):
    rng = random.Random(4)
    words = [[f"{'abcdefgh'[t]}word{k}" for k in range(40)] for t in range(8)]
    topics = {k: rng.randrange(8) for k in range(800)}
    rows = [(k, " ".join(rng.choices(words[t], k=30))) for k, t in topics.items()]
    shared = defaultdict(Counter)
    for p in packing.pack(docs(rows).repartition(4), length=2048).collect():
        shared[p.sequence_id][topics[p.doc_id]] += p.length
    pure = sum(max(c.values()) for c in shared.values()) / sum(sum(c.values()) for c in shared.values())
    assert pure > 0.6  # 0.2 in any order that does not look at the texts
