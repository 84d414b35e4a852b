"""Rules against plain counting; the ratio against plain multinomials; labels separated."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusmill.llm import hashing as hs
from corpusmill.llm import quality, queries

WORD = r"[^\x20\x09-\x0D]+"
LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    text = text or ""
    words, seen, dup = re.findall(WORD, text), set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    counts = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    again = {k for i in range(len(words) - 2) if counts[tuple(words[i:i + 3])] > 1 for k in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(again)


SPECIAL = [None, "", " \n\t", "a", "a a a", "a a a a", "é ü\x0bñ\x85x y", "x\n\nx\n x\nx", "# a | b & <c> $%*", "a b c a b c d e f", "line\nline\r\nline\n"]


def test_rules(docs, real):
    rows = [(i, t) for i, t in enumerate(SPECIAL)] + [(r.doc_id + 1000, r.text) for r in real("documents").collect()]
    got = quality.judge(docs(rows), None).collect()
    assert len(got) == len(rows)
    want = {doc: brute(text) for doc, text in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)


def tokens(text):
    return re.findall(r"[a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff\s]+", (text or "").lower().encode().decode("latin-1"))


def test_classes_are_those_of_plain_tokens():
    """As many unigrams and bigrams as tokens give, and equal classes for equal grams only of one text."""
    texts = ["Hello, world!! hello", "", "a b a b", "x", None, "été..été"]
    data, offsets = hs.text_bytes(pa.array(texts))
    classes, bound = quality.gram_classes(data, offsets)
    for i, text in enumerate(texts):
        t = tokens(text)
        assert bound[i + 1] - bound[i] == len(t) + max(0, len(t) - 1)
    own = [list(classes[a:b]) for a, b in zip(bound[:-1], bound[1:], strict=True)]
    assert own[2][0] == own[2][3] and own[2][2] == own[2][6] and own[2][1] == own[2][5]
    assert own[0][0] == own[0][7]


def test_scores_are_mean_log_ratios(docs):
    ratio = np.random.default_rng(0).normal(size=quality.BUCKETS)
    texts = ["one two three", None, "four, five!", "", "one two " * 2000]
    found = quality.scores(pa.array(texts), ratio)
    data, offsets = hs.text_bytes(pa.array(texts))
    classes, bound = quality.gram_classes(data, offsets)
    want = [float(np.mean(ratio[classes[a:b]])) if b > a else 0.0 for a, b in zip(bound[:-1], bound[1:], strict=True)]
    assert found == pytest.approx(want)


def test_labels_are_separated(spark):
    got = {r.doc_id: r for r in queries.op1_quality_ratio(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    good = [got[x.doc_id] for x in labels if x.quality == 1 and not x.toxic and not got[x.doc_id].base_failed]
    bad = [got[x.doc_id] for x in labels if x.quality == 0 and not got[x.doc_id].base_failed]
    assert sum(r.kept for r in good) / len(good) > 0.99 and sum(r.kept for r in bad) / len(bad) < 0.05


def test_fit_edges(spark, docs):
    texts = docs([(1, "good words here"), (2, "### $$$"), (None, "x"), (1, "good words here")], clash=("quality", "score"))
    assert quality.fit(texts, spark.createDataFrame([], LABELS)) is None
    assert quality.fit(texts, spark.createDataFrame([(None, 1, 0), (2, None, 0), (2, 1, 1)], LABELS)) is None
    model = quality.fit(texts, spark.createDataFrame([(1, 1, 0), (1, 1, None), (2, 0, 0)], LABELS))
    score = {r.doc_id: r.score for r in quality.judge(texts, model).collect()}
    assert score[1] > model.threshold > score[2]
    assert quality.judge(docs([]), model).collect() == []


def test_threshold():
    assert quality.threshold(np.array([]), np.array([]), 0.1) == -np.inf
    assert quality.threshold(np.arange(10.0), np.array([]), 0.2) == 2.0
    assert quality.threshold(np.array([1.0, 2.0]), np.array([-1.0, -1.0, 5.0]), 0.0) == 0.0


@pytest.mark.parametrize("most", [quality.MAX_BROADCAST_IDS, 100])
def test_fit_covers_all_labels(spark, docs, monkeypatch, most):
    """More labelled texts than 10,000 a side: model and threshold are those of all of them."""
    monkeypatch.setattr(quality, "MAX_BROADCAST_IDS", most)
    monkeypatch.setattr(quality, "SORTED", 50)
    monkeypatch.setattr(quality, "RANGES", 16)
    rows = [(i, f"fine word{i % 97} text{i}") for i in range(10_300)] + [(i, f"# $ junk{i % 89} % fine" + " *" * (i % 5)) for i in range(20_000, 30_300)]
    rows += [(None, "no id"), (5, "fine again"), (50_000, "unlabelled words")]
    given = spark.createDataFrame([(r[0], int(r[0] < 20_000), 0) for r in rows[:20_600]], LABELS)
    loss = 0.3
    model = quality.fit(docs(rows), given, loss=loss)

    def counted(some):
        data, offsets = hs.text_bytes(pa.array([r[1] for r in some]))
        return np.bincount(quality.gram_classes(data, offsets)[0], minlength=quality.BUCKETS)

    good = [r for r in rows if r[0] is not None and r[0] < 20_000]
    bad = [r for r in rows if r[0] is not None and 20_000 <= r[0] < 40_000]
    raw, trusted, prior = counted(rows), counted(good), quality.PRIOR * quality.BUCKETS
    base = (raw + 1) / (raw.sum() + quality.BUCKETS)
    assert model.ratio == pytest.approx(np.log((trusted + prior * base) / (trusted.sum() + prior)) - np.log(base))
    own = [np.sort(quality.scores(pa.array([r[1] for r in some]), model.ratio)) for some in (good, bad)]
    assert model.threshold == pytest.approx(quality.threshold(*own, loss))


def test_at_ranks(spark, monkeypatch):
    monkeypatch.setattr(quality, "SORTED", 3)
    monkeypatch.setattr(quality, "RANGES", 4)
    values = [0.0] * 40 + [1e-9 * i for i in range(30)] + [-1e300, 7.5, 7.5, 7.5, 7.5, 1e300]
    df = spark.createDataFrame([(x,) for x in values], "score double")
    ranks = [0, 1, 20, 41, 55, len(values) - 2, len(values) - 1]
    assert quality.at_ranks(df, ranks) == [sorted(values)[k] for k in ranks]
