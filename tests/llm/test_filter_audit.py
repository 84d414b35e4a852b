"""The audit against a plain run of all 120 orders, and the merges against sets."""

from __future__ import annotations

import random
import re
from itertools import permutations

import pytest

from corpusmill.llm import filter_audit as fa


def brute(docs, labels):
    """Rows by (part, order, step) from the written rules, filter by filter."""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    facts, out = [], {}
    for doc, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = "".join(name for name, bad in [
            ("A", len(words) < 100), ("B", 100 * len(set(words)) < 80 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", text)) > 10 * len(text)), ("D", bool(re.search(r"[#$%&*|]", text))),
            ("E", doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in docs))] if bad)
        facts.append((lang or "", failed, doc in good, doc in toxic))
    for part in {f[0] for f in facts}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [f for f in facts if f[0] == part]
            for step, name in enumerate(order, 1):
                gone = [f for f in left if name in f[1]]
                left = [f for f in left if name not in f[1]]
                fails = [f for f in facts if f[0] == part and name in f[1]]
                shapley[name] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(fails) - len(gone), sum(f[1] == name for f in fails),
                                                   sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def rows(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


@pytest.fixture(scope="module")
def tables(spark, docs):
    def make(texts, labels, clash=()):
        return (docs([(d, t, lang) for d, t, lang in texts], clash=clash),
                spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))

    return make


def test_merges_equal_set_operations():
    rng = random.Random(1)
    for _ in range(400):
        top = rng.choice([5, 40, 2000])
        lists = [sorted(rng.sample(range(top), rng.randint(0, min(top, 60)))) for _ in range(rng.randint(1, 5))]
        assert fa.union(lists) == sorted(set().union(*lists))
        assert fa.difference(lists[0], lists[1:]) == sorted(set(lists[0]).difference(*lists[1:]))
        assert fa.shared(lists[0], lists[-1]) == len(set(lists[0]) & set(lists[-1]))
    ids = list(range(0, 3000, 3))
    assert [fa.gallop(ids, s, w) for s in (0, 7, 999) for w in (0, 25, 2997, 9999)] == [
        max(s, p) for s in (0, 7, 999) for p in (0, 9, 999, 1000)]


def test_long_runs_take_few_steps():
    class Counted(list):
        reads = 0

        def __getitem__(self, k):
            Counted.reads += 1
            return super().__getitem__(k)

    long = Counted(range(100_000))
    assert len(fa.difference(long, [[50_000], [99_999]])) == 99_998
    assert Counted.reads < 200


@pytest.mark.parametrize("seed", range(2))
def test_against_all_orders(tables, seed, monkeypatch):
    monkeypatch.setattr(fa, "RANGE", 16)
    rng = random.Random(seed)
    pool = ["one", "two", "THREE", "#four", "é", "FIVE$", *(f"w{k}" for k in range(150))]
    texts = []
    for k in range(150):
        text = rng.choice([None, "", " \n", "same text", " ".join(rng.choices(pool, k=rng.choice([3, 99, 100, 130]))), " ".join(f"x{j}" for j in range(120)), "AB"])
        texts.append((rng.choice([k, k, k, 7, None]), text, rng.choice(["en", "en", "en", "fr", "", None])))
    labels = [(rng.choice([rng.randrange(150), None]), rng.choice([0, 1, 1, None]), rng.choice([0, 1, None])) for _ in range(100)]
    df, marks = tables(texts, labels, clash=("part", "row", "failed", "digest", "words"))
    assert rows(fa.audit(df, marks)) == brute(texts, labels)


def test_a_common_text(tables):
    texts = [(k, "the same" if k % 3 else f"text {k}", "en") for k in range(3000)]
    got = rows(fa.audit(*tables(texts, [])))
    assert got["en", "EABCD", 1][:2] == (1001, 1999)
    assert got == brute_counts(got)


def brute_counts(got):
    """What stays and what goes add up along every order."""
    for (part, order, step), row in got.items():
        before = 3000 if step == 1 else got[part, order, step - 1][0]
        assert row[0] + row[1] == before
    return got


def test_edges(tables):
    assert fa.audit(*tables([], [])).collect() == []
    got = rows(fa.audit(*tables([(None, None, None), (None, None, None)], [(None, 1, 1)])))
    assert len(got) == 600 and got["", "EBCDA", 5] == (0, 2, 0, 2, 0, 0, 240)
    clean = " ".join(f"w{k}" for k in range(100))
    got = rows(fa.audit(*tables([(1, clean, "de"), (1, clean, "de")], [(1, 1, 1)])))
    assert len(got) == 600 and set(got.values()) == {(2, 0, 0, 0, 0, 0, 0)}
    long = clean * 20_000
    got = rows(fa.audit(*tables([(1, long, "de"), (2, long, "fr"), (2, long, "fr")], [(2, 1, 0), (2, 1, 1)])))
    assert got["fr", "EABCD", 1] == (0, 2, 0, 0, 2, 2, got["fr", "EABCD", 1][6])
    assert got["de", "EABCD", 1][:2] == (1, 0)
