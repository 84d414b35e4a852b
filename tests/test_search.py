"""Exact and approximate search, quantisation, rerank, encoders, projection."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import vectors as vx
from corpusmill.operators import ann, embedding, projection, search
from corpusmill.operators.rerank import model_scorer, rerank

RNG = np.random.default_rng(7)
N, DIM, Q = 600, 16, 9
VECTORS = RNG.normal(size=(N, DIM)).astype(np.float32)
VECTORS[200:400] = VECTORS[200]  # a third of all rows are copies of one vector
QUERIES = RNG.normal(size=(Q, DIM)).astype(np.float32)
QUERIES[0] = VECTORS[200]
LANGUAGES = ["go" if i % 3 else "typescript" for i in range(N)]
ASKED = [None, "go", "typescript", "", None, "go", None, None, "rust"]


@pytest.fixture(scope="module")
def index(spark):
    rows = [(f"id{i:04d}", VECTORS[i].tolist(), LANGUAGES[i], f"text {i}", f"f{i}.go") for i in range(N)]
    return spark.createDataFrame(
        rows, "id string, vector array<float>, language string, text string, filepath string").repartition(5)


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(i, QUERIES[i].tolist(), ASKED[i], f"query {i}") for i in range(Q)]
    return spark.createDataFrame(
        rows, "query_id bigint, qvec array<float>, language string, query string")


def brute(k, allowed=None):
    v = VECTORS.astype(float) / np.linalg.norm(VECTORS.astype(float), axis=1, keepdims=True)
    q = QUERIES.astype(float) / np.linalg.norm(QUERIES.astype(float), axis=1, keepdims=True)
    scores = np.round(q @ v.T, 6)
    out = set()
    for n in range(Q):
        rows = [i for i in range(N) if not ASKED[n] or LANGUAGES[i] == ASKED[n]]
        rows = [i for i in rows if allowed is None or allowed(n, i)]
        rows.sort(key=lambda i: (-scores[n, i], i))
        out |= {(n, r + 1, f"id{i:04d}") for r, i in enumerate(rows[:k])}
    return out


def found(df):
    return {(r.query_id, r["rank"], r.id) for r in df.collect()}


@pytest.mark.parametrize("k", [1, 7, 40, 1000])
def test_exact_matches_brute_force(index, queries, k):
    assert found(search.knn_search(index, queries, k, with_rows=False)) == brute(k)


def test_k_is_a_prefix_of_k_plus_one(index, queries):
    big = search.knn_search(index, queries, 12, with_rows=False)
    small = search.knn_search(index, queries, 11, with_rows=False)
    assert found(big.where("rank <= 11")) == found(small)


def test_a_block_of_copies_yields_k_rows():
    s = np.array([[1.0, 0.5, 0.5, 0.5, 0.5, 0.2], [0.5] * 6, [0.9, 0.8, 0.1, 0.1, 0.1, 0.1]])
    ids = np.array([5, 4, 3, 2, 1, 0])
    kept = search._kept(s, np.full(3, -np.inf), 2, lambda: np.argsort(ids))
    assert [np.flatnonzero(r).tolist() for r in kept] == [[0, 4], [4, 5], [0, 1]]
    floored = search._kept(s, np.array([0.5, 0.6, 0.85]), 2, lambda: np.argsort(ids))
    assert [np.flatnonzero(r).tolist() for r in floored] == [[0, 4], [], [0]]


def test_grid_plan_equals_block_plan(index, queries, monkeypatch):
    monkeypatch.setattr(search, "MAX_BLOCK_QUERIES", 4)
    monkeypatch.setattr(search, "MAX_BLOCK_BYTES", 100 * DIM * 8)
    monkeypatch.setattr(search, "GRID_QUERY_BYTES", 4 * DIM * 8)
    assert found(search.knn_search(index, queries, 7, with_rows=False)) == brute(7)


def test_rows_come_back_after_the_top_k(index, queries):
    hits = search.knn_search(index, queries, 3)
    assert hits.columns == ["query_id", "rank", "score", "id", "text", "filepath", "language"]
    assert all(r.text == f"text {int(r.id[2:])}" for r in hits.collect())


def test_no_cross_join_in_the_plan(index, queries):
    plan = search.knn_search(index, queries, 3)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "WindowGroupLimit" in plan


def test_more_results_than_candidates(index, queries, spark):
    """Asking for more than there are candidates gives the candidates."""
    texts = index.withColumn("text", F.col("id"))
    asked = queries.select("query_id", F.lit("some words").alias("query"))
    hits = search.knn_search(index, queries, 4, with_rows=False).join(texts.select("id", "text"), "id")
    assert rerank(hits, asked, n=9).count() == hits.count() > 4


def test_bad_arguments(index, queries, spark):
    with pytest.raises(ValueError):
        search.knn_search(index, queries, 0)
    with pytest.raises(ValueError):
        rerank(index, queries, n=0)
    short = spark.createDataFrame([("a", [1.0, 2.0])], "id string, vector array<float>")
    with pytest.raises(Exception, match="differ in length"):
        search.knn_search(short, queries, 3, with_rows=False).collect()


def test_empty_sides(index, queries):
    assert search.knn_search(index.limit(0), queries, 3).count() == 0
    assert search.knn_search(index, queries.limit(0), 3).count() == 0


@pytest.fixture(scope="module")
def planted(spark):
    """30 tight clusters, one of them with a third of the vectors; 12 queries."""
    centers = RNG.normal(size=(30, 24))
    label = np.r_[np.zeros(700, int), RNG.integers(1, 30, 1400)]
    points = centers[label] + RNG.normal(scale=0.15, size=(2100, 24))
    asked = centers[:12] + RNG.normal(scale=0.15, size=(12, 24))
    index = spark.createDataFrame(
        [(f"p{i:05d}", p.tolist()) for i, p in enumerate(points)],
        "id string, vector array<float>").repartition(8)
    queries = spark.createDataFrame(
        [(i, p.tolist()) for i, p in enumerate(asked)], "query_id bigint, qvec array<float>")
    return index, queries


def recall(approximate, exact):
    want = {(r.query_id, r.id) for r in exact.collect()}
    got = {(r.query_id, r.id) for r in approximate.collect()}
    return len(want & got) / len(want)


def test_ivf_on_clusters(planted):
    index, queries = planted
    exact = search.knn_search(index, queries, 10, with_rows=False)
    centers = ann.fit_cells(index, cells=24)
    celled = ann.assign_cells(index, centers)
    got = ann.ann_ivf(celled, queries, centers, probes=3, k=10, with_rows=False)
    probing = ann._nearest_cells(queries, "qvec", "qcells", centers, 3)
    pairs = ann.compared_pairs(celled, probing).first()
    assert recall(got, exact) >= 0.9
    assert pairs.compared < 0.5 * pairs.exact == 0.5 * 2100 * 12


def test_ivf_with_all_cells_is_exact(index, queries):
    centers = ann.fit_cells(index, cells=5)
    got = ann.ann_ivf(ann.assign_cells(index, centers), queries, centers, 5, 7, with_rows=False)
    assert found(got) == brute(7)


def test_ivf_reads_a_table_partitioned_by_cell(planted, tmp_path):
    index, queries = planted
    centers = ann.fit_cells(index, cells=6)
    celled = ann.assign_cells(index, centers)
    celled.drop("cells").write.partitionBy("cell").parquet(str(tmp_path / "t"))
    back = index.sparkSession.read.parquet(str(tmp_path / "t"))
    plan = ann.ann_ivf(back, queries, centers, 1, 5, with_rows=False)._jdf.queryExecution().toString()
    assert "cell" in plan[plan.index("PartitionFilters"):][:60]
    assert found(ann.ann_ivf(back, queries, centers, 2, 5, with_rows=False)) == found(
        ann.ann_ivf(celled, queries, centers, 2, 5, with_rows=False))


def test_lsh_on_clusters(planted):
    index, queries = planted
    exact = search.knn_search(index, queries, 10, with_rows=False)
    got = ann.ann_lsh(index, queries, 10, bucket_length=1.0, tables=6, with_rows=False)
    cells = ann.lsh_cells(index, queries, 1.0, 6)
    pairs = ann.compared_pairs(cells.index, cells.queries).first()
    assert recall(got, exact) >= 0.9
    assert 0 < pairs.compared < 6 * pairs.exact


def test_lsh_compares_exactly_the_bucket_mates(index, queries):
    cells = ann.lsh_cells(index, queries, 0.7, 3)
    own = {r.id: set(r.cells) for r in cells.index.select("id", "cells").collect()}
    probe = {r.query_id: set(r.qcells) for r in cells.queries.select("query_id", "qcells").collect()}
    got = ann.ann_lsh(index, queries, 7, bucket_length=0.7, tables=3, with_rows=False)
    assert found(got) == brute(7, lambda n, i: bool(probe[n] & own[f"id{i:04d}"]))


def test_quantised_search(planted):
    index, queries = planted
    quantizer = ann.fit_quantizer(index)
    coded = ann.quantize_vectors(index, quantizer)
    flat = coded.select(F.explode("codes").alias("c")).agg(F.min("c"), F.max("c")).first()
    assert tuple(flat) == (0, 255)
    exact = search.knn_search(index, queries, 10, with_rows=False)
    assert recall(ann.knn_quantized(coded, index, queries, quantizer, 10), exact) >= 0.99


def test_codes_are_scored_as_the_vectors_they_stand_for(planted):
    """Bytes, arrays and decoded vectors give the same rough ranking, also for a length of 0."""
    index, queries = planted
    zero = F.transform("vector", lambda x: F.lit(0.0).cast("float"))
    index = index.unionByName(index.limit(1).withColumns({"id": F.lit("zero"), "vector": zero}))
    quantizer = ann.fit_quantizer(index)
    packed, listed = ann.pack_codes(index, quantizer), ann.quantize_vectors(index, quantizer)
    bytes_of = {r.id: list(r.codes) for r in packed.select("id", "codes").collect()}
    assert bytes_of == {r.id: list(r.codes) for r in listed.select("id", "codes").collect()}
    kernel = ann._code_kernel(quantizer)

    def scores(hits):
        return {(r.query_id, r["rank"]): r.score for r in hits.collect()}

    want = scores(search.knn_search(ann.dequantize(listed, quantizer), queries, 20, with_rows=False))
    for coded in (packed, listed):
        got = scores(search.knn_search(coded, queries, 20, with_rows=False, kernel=kernel))
        assert got.keys() == want.keys()
        assert all(abs(got[x] - want[x]) < 3e-6 for x in want)
    assert ann.pack_codes(index.limit(0), quantizer).count() == 0
    assert ann.knn_quantized(packed.limit(0), index, queries, quantizer, 3).count() == 0
    assert recall(ann.knn_quantized(packed, index, queries, quantizer, 10),
                  search.knn_search(index, queries, 10, with_rows=False)) >= 0.99


def test_rerank_is_stable_and_bounded(spark):
    hits = spark.createDataFrame(
        [(1, r, 0.9, f"h{r}", t) for r, t in enumerate(["b c", "a b", "b a", "x", "a b"], 1)],
        "query_id bigint, rank int, score double, id string, text string")
    queries = spark.createDataFrame([(1, "A b")], "query_id bigint, query string")
    out = rerank(hits, queries, n=4).orderBy("rank").collect()
    assert [r.id for r in out] == ["h2", "h3", "h5", "h1"]
    assert [round(r.rerank_score, 3) for r in out] == [1.0, 1.0, 1.0, 0.333]
    assert rerank(hits, queries, n=50).count() == 5


def test_jaccard_pair_cap(spark):
    from corpusmill.operators.rerank import jaccard

    df = spark.createDataFrame([("a b", "a x b y")], "query string, text string")
    q, t = F.col("query"), F.col("text")
    row = df.select(
        jaccard(q, t).alias("whole"), jaccard(q, t, 3).alias("three"), jaccard(q, t, 1).alias("one"),
        jaccard(F.lit(""), F.lit("")).alias("none")).first()
    assert tuple(row) == (0.5, 0.5, 0.0, 0.0)


def test_has_dim(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "v array<float>")
    assert df.where(vx.has_dim(F.col("v"), 2)).count() == 1


def test_model_scorer_and_model_encoder(spark):
    def load_scorer():
        return lambda queries, texts: np.array(
            [len(q) + len(t) for q, t in zip(queries, texts, strict=True)], dtype=float)

    def load_encoder():
        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

    df = spark.createDataFrame([("ab", "cde"), ("", "f")], "query string, text string")
    scores = df.select(model_scorer(load_scorer)(F.col("query"), F.col("text")).alias("s"))
    assert sorted(r.s for r in scores.collect()) == [1.0, 5.0]
    vectors = embedding.embed(df, embedding.model(load_encoder, 2)).select("vector").collect()
    assert sorted(r.vector for r in vectors) == [[10.0, 1.0], [12.0, 1.0]]


def test_hashed_encoder(spark):
    df = spark.createDataFrame(
        [("a", "Foo foo bar"), ("b", ""), ("c", "word " * 5000)], "id string, text string")
    rows = {r.id: np.array(r.vector) for r in embedding.embed(df, embedding.hashed(32), prefix="").collect()}
    assert np.isclose(np.linalg.norm(rows["a"]), 1.0)
    assert sorted(np.round(rows["a"][rows["a"] > 0] ** 2, 4).tolist()) in ([0.2, 0.8], [1.0])
    assert not rows["b"].any()
    assert np.isclose(rows["c"].max(), 1.0)
    assert embedding.embed(df.limit(0), embedding.hashed(32)).count() == 0


def test_hashed_encoder_hashes_a_word_once(spark, monkeypatch):
    """Counts of md5 buckets, whatever stands between words; no hash per word in the plan."""
    texts = [None, "", " - ", "one", "\tÉTÉ été x² 日本_語 a·b\n", "Foo, foo; BAR! " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = embedding.embed(df, embedding.hashed(64), prefix="")
    for r in found.collect():
        counts = np.zeros(64)
        for word in re.findall(r"\w+", (texts[r.id] or "").lower()):
            counts[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 64] += 1
        assert np.allclose(r.vector, counts / max(1.0, np.linalg.norm(counts)))
    capped = embedding.embed(df.where("id = 5"), embedding.hashed(64, 2), prefix="").collect()[0].vector
    assert sum(x > 0 for x in capped) == 1
    assert not re.search(r"\b(md5|conv)\(", found._jdf.queryExecution().optimizedPlan().toString())
    hashed = []
    monkeypatch.setattr(embedding, "md5", lambda w, **kw: hashed.append(w) or hashlib.md5(w, **kw))
    embedding._buckets(pa.array(["a", "b", "a", "b", "a"]), 8)
    assert sorted(hashed) == [b"a", b"b"]


def test_batch_larger_than_a_slice(spark, monkeypatch):
    """Slices of a batch give the best k of the whole, ties by id."""
    df = spark.createDataFrame([(f"{i:03d}", [1.0, float(i % 7)]) for i in range(100)], "id string, vector array<float>").coalesce(1)
    asked = spark.createDataFrame([(1, [0.0, 1.0])], "query_id int, qvec array<double>")
    monkeypatch.setattr(search, "SLICE_ROWS", 8)
    got = search.knn_search(df, asked, 20, with_rows=False).orderBy("rank").collect()
    want = sorted(range(100), key=lambda i: (-(i % 7), i))[:20]
    assert [r.id for r in got] == [f"{i:03d}" for i in want]


def test_mean_pool_and_normalise(spark):
    rows = [("k", [1.0, 2.0], 1), ("k", [3.0, 6.0], 1), ("k", [100.0, 100.0], 0), ("z", [1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "key string, vec array<float>, mask int")
    pooled = embedding.mean_pool(df, "key").collect()
    assert [(r.key, r.vec) for r in pooled] == [("k", [2.0, 4.0])]
    unit = df.select(vx.l2_normalize(F.col("vec")).alias("u"), vx.l2_norm(F.col("vec")).alias("n"))
    assert all(np.isclose(np.linalg.norm(r.u), 1.0) for r in unit.collect())


def test_pca_matches_svd(index):
    got = {r.id: (r.x, r.y) for r in projection.pca_2d(index).collect()}
    centred = VECTORS.astype(float) - VECTORS.astype(float).mean(axis=0)
    _, _, rows = np.linalg.svd(centred, full_matrices=False)
    axes = [a * np.sign(a[np.argmax(np.abs(a))]) for a in rows[:2]]
    want = centred @ np.array(axes).T
    mine = np.array([got[f"id{i:04d}"] for i in range(N)])
    assert np.allclose(mine, want, atol=1e-6)


def test_map_needs_ten_rows(index):
    with pytest.raises(ValueError, match="at least 10"):
        projection.pca_2d(index.limit(9))
