"""Leaks planted in known places; alignment against a plain table."""

from __future__ import annotations

import random

import numpy as np
import pytest

from corpusmill.llm.decontamination import GAP, MATCH, MISMATCH, Matcher, align, leaks, located, without_leaks

ITEMS = "item_id long, text string"


def plain_score(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (MATCH if x == y else MISMATCH), table[i - 1][j] + GAP, table[i][j - 1] + GAP)
            best = max(best, table[i][j])
    return best


@pytest.mark.parametrize("seed", range(4))
def test_alignment_matches_the_full_table(seed):
    rng = random.Random(seed)
    for _ in range(40):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 25))] for _ in range(2))
        score, low, high = located(np.array(a), np.array(b))
        assert score == align(np.array(a), np.array(b))[0] == plain_score(a, b)
        assert plain_score(a, b[low:high]) == score


def planted():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(15, 60)))) for i in range(30)]
    rows, want = [], {}
    for doc in range(200):
        text = [rng.choice(words) for _ in range(rng.randint(0, 400))]
        if doc % 4 == 0:
            item, source = rng.choice(items)
            copy = source.upper().split() if doc % 8 == 0 else source.split()
            for k in range(0, len(copy), 8) if doc % 3 == 0 else ():
                copy[k] = rng.choice(words)
            if doc % 5 == 0:
                del copy[len(copy) // 2]
            at = rng.randint(0, len(text))
            text[at:at] = [w + rng.choice(["", ",", "."]) for w in copy]
            want[doc] = (item, at, at + len(copy))
        rows.append((doc, " ".join(text)))
    return rows, items, want


@pytest.mark.parametrize("block_bytes", [4 << 20, 2000])
def test_planted_leaks(spark, docs, block_bytes):
    rows, items, want = planted()
    df, bench = docs(rows, clash=("item_id", "score")), spark.createDataFrame(items, ITEMS)
    got = {(r.doc_id, r.item_id): r for r in leaks(df, bench, block_bytes=block_bytes).collect()}
    assert set(got) == {(doc, item) for doc, (item, _, _) in want.items()}
    for doc, (item, low, high) in want.items():
        r = got[doc, item]
        assert abs(r.first_word - low) <= 2 and abs(r.end_word - high) <= 2 and r.score >= 0.6
    kept = without_leaks(df, bench, block_bytes=block_bytes)
    assert {r.doc_id for r in kept.collect()} == {doc for doc, _ in rows} - set(want)
    assert kept.columns == df.columns


def test_a_passage_that_is_everywhere(spark, docs):
    """Seeds stay seeds when the passage is in most documents."""
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, f"start{i} {passage} end{i}" if i % 3 else f"clean{i} text only") for i in range(300)]
    got = leaks(docs(rows), spark.createDataFrame([(1, passage), (1, passage), (2, "never seen words at all")], ITEMS)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, 1) for i in range(300) if i % 3]


def test_edges(spark, docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, "two words"), (None, "a b c d e f g h"), (6, "!!! ...")], ITEMS)
    rows = [(1, None), (2, ""), (3, "zero one"), (4, "Two, words"), (None, "a b c d e f g h"), (5, "a b c d e f g h"), (5, "a b c d e f g h")]
    got = sorted(((r.doc_id, r.item_id) for r in leaks(docs(rows), items).collect()), key=repr)
    assert got == sorted([(3, 3), (4, 4), (None, None), (5, None), (5, None)], key=repr)
    assert leaks(docs([]), items).collect() == []
    assert leaks(docs(rows), items.limit(0)).collect() == []
    assert without_leaks(docs(rows), items.limit(0)).count() == len(rows)


def test_long_text(spark, docs):
    text = " ".join(f"w{i}" for i in range(300_000))
    item = " ".join(f"w{i}" for i in range(250_000, 250_040))
    got = leaks(docs([(1, text)]), spark.createDataFrame([(1, item)], ITEMS)).collect()
    assert [(r.first_word, r.end_word, r.score) for r in got] == [(250_000, 250_040, 1.0)]


def test_benchmark_passages_in_documents(real):
    texts, items = real("documents").collect(), real("benchmark").collect()
    verbatim = {(d.doc_id, i.item_id) for d in texts for i in items if i.text in d.text}
    got = {(r.doc_id, r.item_id) for r in leaks(real("documents"), real("benchmark")).collect()}
    assert verbatim and verbatim <= got


def edited(rng, words, source, kind):
    if kind in (4, 5, 6):  # one word in so many is another
        return [rng.choice(words) if k % kind == rng.randrange(2) else w for k, w in enumerate(source)]
    if kind == "between":  # a word after most words, which leaves no two neighbours
        return [x for k, w in enumerate(source) for x in ([w, "more"] if k % 5 else [w])]
    if kind == "gone":
        return [w for k, w in enumerate(source) if k % 5 != 2]
    return source[:len(source) * 2 // 3]


def test_every_alignment_above_the_bound_is_found(spark, docs):
    """All pairs against the full table, for copies without a run of six unchanged words."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    items = [(i, [rng.choice(words) for _ in range(n)]) for i, n in enumerate([2, 3, 5, 8, 12, 20, 24, 36])]
    rows = []
    for kind in (4, 5, 6, "between", "gone", "part"):
        for item, source in items:
            own = [rng.choice(words) for _ in range(20)] + edited(rng, words, source, kind) + [rng.choice(words) for _ in range(20)]
            rows.append((len(rows), own))
    got = {(r.doc_id, r.item_id): r.score for r in leaks(
        docs([(d, " ".join(x)) for d, x in rows]), spark.createDataFrame([(i, " ".join(x)) for i, x in items], ITEMS)).collect()}
    want = {(d, i): plain_score(x, text) / (MATCH * len(x)) for d, text in rows for i, x in items}
    assert got == {key: score for key, score in want.items() if score >= 0.6}
    assert len(got) > 30


def test_seeds_are_the_rarest_bigrams():
    words = [np.arange(1, 21, dtype=np.uint64), np.arange(50, 54, dtype=np.uint64)]
    matcher = Matcher(words, 0.6)
    assert list(matcher.gram) == [2, 1] and list(matcher.whole) == [3, 3] and list(matcher.asked) == [2, 1]
    often = {int(g): 5 for g in matcher.grams[0][:4]}
    matcher.choose(often)
    # Of 19 bigrams any 18 hold two of the three that every leak has; the one left out is the last of the frequent.
    assert sorted(matcher.place[matcher.item == 0]) == [x for x in range(19) if x != 3]
    assert sorted(matcher.place[matcher.item == 1]) == [0, 1]


@pytest.mark.parametrize("seed", range(3))
def test_no_alignment_above_the_bound_has_fewer_whole_bigrams(seed):
    rng = random.Random(seed)
    for _ in range(300):
        n = rng.randint(1, 30)
        item, text = list(range(n)), []
        rate = rng.random() * 0.9
        for w in item:
            kind = rng.choice(["insert", "insert", "other", "gone"]) if rng.random() < rate else ""
            text += [w] if not kind else [w, 1000] if kind == "insert" else [1000] if kind == "other" else []
        if plain_score(item, text) < 0.6 * MATCH * n:
            continue
        matcher = Matcher([np.array(item, np.uint64)], 0.6)
        size = int(matcher.gram[0])
        runs = {tuple(text[k:k + size]) for k in range(len(text))}
        assert sum(tuple(item[k:k + size]) in runs for k in range(n - size + 1)) >= matcher.whole[0]


def test_a_bigram_over_the_end_of_a_text_is_none(spark, docs):
    """The first words of an item end one document, its last begin the next."""
    rows = [(1, "x y a b c"), (2, "d e f g h"), (3, "a b c d e f")]
    got = leaks(docs(rows), spark.createDataFrame([(1, "a b c d e f")], ITEMS)).collect()
    assert [(r.doc_id, r.score) for r in got] == [(3, 1.0)]
