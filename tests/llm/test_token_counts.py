"""Counts after edits against encoding the edited text as a whole."""

from __future__ import annotations

import random

import pytest

from corpusmill.llm.token_counts import VOCABULARY, CountTree, Tokenizer, counted, redactions

POOL = ["", "a", " ", "  ", "\n\n", " x", "'s", "'", "12", "é", "!!", "\t", "word and", " \n", "🙂"]


@pytest.fixture(scope="module")
def tokenizer():
    with open(VOCABULARY, "rb") as file:
        return Tokenizer(file.read())


def full(tokenizer, text):
    return len(tokenizer.encoding.encode_ordinary(text))


@pytest.mark.parametrize("seed", range(3))
def test_edits_of_short_texts(tokenizer, seed):
    rng = random.Random(seed)
    for _ in range(1500):
        text = "".join(rng.choice(POOL) for _ in range(rng.randint(0, 12)))
        tree = CountTree(text, tokenizer)
        for _ in range(5):
            a = rng.randint(0, len(text))
            b, new = rng.randint(a, min(len(text), a + 6)), rng.choice(POOL)
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert (tree.text(), tree.length, tree.total) == (text, len(text), full(tokenizer, text))


def test_edits_touch_little_of_a_long_text(tokenizer, real):
    text = "\n".join(r.text for r in real("documents").collect())
    tree, rng = CountTree(text, tokenizer), random.Random(2)
    for _ in range(100):
        a = rng.randint(0, len(text))
        b, new = min(len(text), a + rng.choice([0, 1, 3, 30])), rng.choice(POOL)
        tree.edit(a, b, new)
        text = text[:a] + new + text[b:]
    assert (tree.text() == text, tree.total) == (True, full(tokenizer, text))
    assert tree.encoded < 100 * 25


def test_edit_outside_the_text(tokenizer):
    with pytest.raises(ValueError):
        CountTree("abc", tokenizer).edit(2, 9, "")


def test_documents(tokenizer, real):
    got = {r.doc_id: r for r in counted(real("documents")).collect()}
    edited = 0
    for d in real("documents").collect():
        text = d.text
        edits = list(redactions(text))
        for a, b, new in edits:
            text = text[:a] + new + text[b:]
        r = got[d.doc_id]
        assert (r.n_tokens, r.n_edits, r.n_tokens_edited) == (full(tokenizer, d.text), len(edits), full(tokenizer, text))
        edited += len(edits)
    assert edited


def test_edges(docs):
    rows = [(1, None), (2, ""), (3, "mail a@b.cd now"), (3, "mail a@b.cd now"), (None, "x"), (4, "é 192.168.0.1 " * 20_000)]
    got = sorted(((r.doc_id, r.n_edits, r.n_tokens > 0) for r in counted(docs(rows, clash=("n_tokens",))).collect()), key=repr)
    assert got == sorted([(1, 0, False), (2, 0, False), (3, 1, True), (3, 1, True), (None, 0, True), (4, 20_000, True)], key=repr)
    assert counted(docs([])).collect() == []
