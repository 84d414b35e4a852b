"""Held-out accuracy, and forward-backward against all label sequences."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest

from corpusmill.llm import language_id, queries


def test_posteriors_match_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 4, 2, 5])
    emission, transition = rng.normal(size=(12, 3)), rng.normal(size=(3, 3))
    gamma, pairs = language_id._posteriors(emission, transition, lengths, expected=True)
    at, want_pairs = 0, np.zeros((3, 3))
    for n in lengths:
        total, own = 0.0, np.zeros((n, 3))
        both = np.zeros((3, 3))
        for labels in product(range(3), repeat=int(n)):
            p = np.exp(sum(emission[at + i, y] for i, y in enumerate(labels)) + sum(transition[a, b] for a, b in zip(labels, labels[1:])))
            total += p
            for i, y in enumerate(labels):
                own[i, y] += p
            for a, b in zip(labels, labels[1:]):
                both[a, b] += p
        assert gamma[at:at + n] == pytest.approx(own / total)
        want_pairs += both / total
        at += n
    assert pairs == pytest.approx(want_pairs)


@pytest.fixture(scope="module")
def model(spark):
    return language_id.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op4_language_id(spark, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in got.values() if r.held_out]
    assert len(got) == len(truth) and 0.15 < len(held) / len(truth) < 0.35
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_code_switched_words(spark, model, real):
    texts = {lang: [r.text for r in real("documents").collect() if r.lang == lang and len(r.text) > 500] for lang in ("en", "fr", "de")}
    parts = [(lang, " ".join(texts[lang][0].split()[20:45])) for lang in ("en", "de", "fr")]
    text = " ".join(p for _, p in parts)
    rows = spark.createDataFrame([(1, text), (2, None), (3, "12 !")], "doc_id long, text string")
    runs = language_id.label_words(rows, model).collect()
    assert {r.doc_id for r in runs} == {1}
    covered = {lang: 0 for lang in texts}
    at = 0
    for lang, part in parts:
        for r in runs:
            if r.lang == lang:
                covered[lang] += max(0, min(r.end, at + len(part)) - max(r.start, at))
        assert covered[lang] > 0.8 * len(part)
        at += len(part) + 1


def test_edges(docs, model):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the of and that with for this"), (4, "the of and that with for this"), (None, "the of and that"), (5, "the of\n" * 50_000)]
    got = {(r.doc_id, r.lang_pred, r.score > 0) for r in language_id.identify(docs(rows, clash=("lang_pred", "score")), model).collect()}
    assert got == {(1, "und", False), (2, "und", False), (3, "und", False), (4, "en", True), (None, "en", True), (5, "en", True)}
    kept = language_id.identified_only(docs(rows, clash=("score",)), model)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([4, 4, None, 5], key=repr) and "score" in kept.columns


def test_nothing_to_learn_from(docs):
    empty = docs([])
    assert language_id.train(empty) is None
    assert language_id.identify(empty, None).collect() == []
    assert [(r.lang_pred, r.score) for r in language_id.identify(docs([(1, "text")]), None).collect()] == [("und", 0.0)]
    one = docs([(0, "only one language here"), (1, "and more of it"), (4, "still the same")])
    found = language_id.identify(one, language_id.train(one)).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("en", 1.0)}


def test_predictions_ignore_everything_but_the_text(docs, model):
    a = language_id.identify(docs([(1, "la de que el los", "en", "x")]), model).first()
    b = language_id.identify(docs([(9, "la de que el los", "fr", "y")]), model).first()
    assert (a.lang_pred, a.score) == (b.lang_pred, b.score)


def test_texts_in_several_languages_stay(docs, model, real):
    texts = {lang: next(r.text for r in real("documents").collect() if r.lang == lang and len(r.text) > 500) for lang in ("en", "fr", "de")}
    mixed = "\n".join(" ".join(x.split()[20:60]) for x in texts.values())
    rows = docs([(1, mixed), (2, "12 !")])
    assert language_id.identify(rows.filter("doc_id = 1"), model).first().score < language_id.MIN_SCORE
    assert [r.doc_id for r in language_id.identified_only(rows, model).collect()] == [1]


def test_certainty_is_judged_per_word():
    class Fixed:
        """Posteriors by a word's first letter: a, b and c are languages, others fit none."""
        labels = ["a", "b", "c"]

        def label(self, text):
            words = language_id.Words(text)
            first = [text[i - 4] for i in words.start.tolist()]
            return words, np.array([np.eye(3)["abc".index(x)] if x in "abc" else np.full(3, 1 / 3) for x in first])

    _, scores, certain = language_id.predict(["aa bb cc", "xx yy zz", "aa aa", None], Fixed())
    assert scores == pytest.approx([1 / 3, 1 / 3, 1, 0]) and certain == pytest.approx([1, 1 / 3, 1, 0])
