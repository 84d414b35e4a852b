"""Targets against the written rule, the tree's exact counts and its distribution."""

from __future__ import annotations

import random
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import mixing, queries
from corpusmill.llm.mixing import mix_sources


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Give by weight, stop full sources, give the excess to the rest until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not full:
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 10, "c": 1, None: 50}, {"b": 5}, {"a": 0, "b": 0}, {"z": 7, "é": 1000, "Z": 3, "": 20}, {f"s{i}": i * i for i in range(20)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_hypergeometric_follows_its_distribution(spark):
    def c(x):
        return F.lit(x).cast("long")

    n, (good, bad, drawn) = 20_000, (30, 20, 12)
    found = Counter(r.k for r in spark.range(n).select(
        mixing._hypergeometric(c(good), c(bad), c(drawn), mixing._uniform(F.col("id"))).alias("k")).collect())
    chi = sum((found[k] - e) ** 2 / e for k in range(drawn + 1)
              if (e := n * comb(good, k) * comb(bad, drawn - k) / comb(good + bad, drawn)) > 5)
    assert chi < 35


@pytest.mark.parametrize("good,bad,drawn", [(0, 5, 3), (5, 0, 3), (5, 5, 0), (5, 5, 10), (10**7, 10**7, 10**7)])
def test_hypergeometric_stays_in_range(spark, good, bad, drawn):
    row = spark.range(50).select(mixing._hypergeometric(*(F.lit(x).cast("long") for x in (good, bad, drawn)), mixing._uniform(F.col("id"))).alias("k"))
    assert all(max(0, drawn - bad) <= r.k <= min(good, drawn) for r in row.collect())


@pytest.mark.parametrize("shards", [1, 2, 5, 8])
def test_tree_deals_exact_quotas(spark, shards):
    quotas = {(1, 0): 20, (1, 1): 3, (2, 0): 50, (3, 0): 1}
    df = spark.createDataFrame([(*k, v) for k, v in quotas.items()], "source_no int, epoch int, blocks long")
    rows = mixing.split_tree(df, shards).collect()
    total, per_shard = Counter(), Counter()
    for r in rows:
        total[r.source_no, r.epoch] += r.blocks
        per_shard[r.shard] += r.blocks
    assert dict(total) == quotas
    assert max(per_shard.values()) - min(per_shard[s] for s in range(shards)) <= 2


def corpus():
    rng = random.Random(3)
    return [(i, " ".join(["w"] * rng.choice([0, 1, 5, 20, 80])), "en", rng.choice(["hot"] * 6 + ["a", "b", None])) for i in range(1500)]


def check(rows, got):
    sizes, words, taken = Counter(), {}, Counter()
    for doc, text, _, source in rows:
        sizes[source] += len((text or "").split())
        words[doc] = (source, len((text or "").split()))
    want = brute_targets(sizes)
    for doc, n in got.items():
        assert n <= 2
        taken[words[doc][0]] += n * words[doc][1]
    for source, target in want.items():
        assert abs(taken[source] - target) <= 80


def test_mix_meets_targets_and_repeats(docs):
    rows = corpus()
    options = {"block_words": 300, "shard_words": 5_000}
    mix = mix_sources(docs(rows, clash=("mix_shard", "source_no", "room", "block")), **options)
    found = mix.collect()
    check(rows, Counter(r.doc_id for r in found))
    assert len({r.mix_shard for r in found}) > 4
    assert {"source_no", "room", "block"} <= set(mix.columns) and found[0].room == "other"
    again = mix_sources(docs(rows), **options).collect()
    assert Counter((r.doc_id, r.mix_epoch, r.mix_shard, r.mix_block) for r in found) == Counter((r.doc_id, r.mix_epoch, r.mix_shard, r.mix_block) for r in again)
    assert all(n == 1 for n in Counter((r.doc_id, r.mix_epoch) for r in found).values())


def test_mix_edges(docs):
    rows = [(1, None, "en", "a"), (2, "", "en", None), (None, "x y", "en", "a"), (3, "x y", "en", "a"), (3, "x y", "en", "a")]
    found = mix_sources(docs(rows)).collect()
    assert Counter(r.doc_id for r in found)[3] <= 4
    assert mix_sources(docs([])).collect() == []
    assert mix_sources(docs([(1, None), (2, "")])).columns[-3:] == ["mix_epoch", "mix_shard", "mix_block"]


def test_query_on_documents(spark, real):
    got = queries.op2_source_mixing(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: (r.source, len(r.text.split())) for r in real("documents").collect()}
    sizes, taken = Counter(), Counter()
    for source, n in texts.values():
        sizes[source] += n
    want = brute_targets(sizes)
    for r in got:
        source, n = texts[r.doc_id]
        assert (r.size, r.source_size, r.target) == (n, sizes[source], pytest.approx(want[source]))
        assert r.taken in (0, n, 2 * n)
        taken[source] += r.taken
    longest = max(n for _, n in texts.values())
    assert len(got) == len(texts) and all(abs(taken[s] - want[s]) <= longest / 2 for s in sizes)
