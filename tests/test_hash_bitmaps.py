"""Bitmaps of stored hashes and the insert that uses them."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import hash_bitmaps as hb
from corpusmill.operators import maintenance as m
from corpusmill.operators.chunking import chunk_documents
from corpusmill.operators.embedding import hashed
from corpusmill.sources import snapshots

ENC = hashed(8)


def text(tag, lines=60):
    return "\n".join(f"{tag} line {i} with some words in it" for i in range(lines))


def keys(df):
    return sorted(tuple(r) for r in df.select("id", "filepath", "start_line", "end_line", "text_hash").collect())


def hashes(spark, values):
    return spark.createDataFrame([(hashlib.md5(str(v).encode()).hexdigest(),) for v in values], "text_hash string")


def test_all_stored_hashes_and_few_others_are_possible(spark):
    stored, asked = hashes(spark, range(5000)), hashes(spark, range(4900, 9900))
    buckets = hb.bucket_count(5000)
    bitmaps = hb.hash_bitmaps(stored, buckets)
    assert {r.buckets for r in bitmaps.collect()} == {buckets} and bitmaps.count() == buckets
    assert bitmaps.agg(F.sum(F.bitmap_count("bits"))).first()[0] <= 5000
    possible = {r.text_hash for r in hb.possible_hashes(asked, bitmaps, buckets).collect()}
    known = {r.text_hash for r in stored.intersect(asked).collect()}
    assert known <= possible
    assert len(possible - known) < 2 * 4900 / hb.BITS_PER_HASH  # reach the exact lookup in vain


def test_each_bit_is_found_again(spark):
    """One hash at a time, so that a wrong byte or bit shows."""
    for value in range(12):
        own = hashes(spark, [value])
        bitmaps = hb.hash_bitmaps(own, 3)
        assert hb.possible_hashes(own, bitmaps, 3).count() == 1
        assert hb.possible_hashes(hashes(spark, range(100, 140)), bitmaps, 3).count() == 0


def test_versions_are_merged(spark):
    one, two = hashes(spark, range(100)), hashes(spark, range(50, 300))
    both = hb.merged(hb.hash_bitmaps(one, 2).union(hb.hash_bitmaps(two, 2)))
    whole = hb.hash_bitmaps(hashes(spark, range(300)), 2)
    assert both.exceptAll(whole.select("bucket", "bits")).count() == 0 and both.count() == whole.count()


def test_no_bitmap_is_shuffled(spark):
    plan = hb.hash_bitmaps(hashes(spark, range(9)), 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(bucket") == 1 and plan.count("Exchange") == 1


@pytest.mark.parametrize("pushed,sent", [(10_000, 500_000), (0, 0)])
def test_insert_equals_upsert(spark, files, tmp_path, monkeypatch, pushed, sent):
    monkeypatch.setattr(hb, "MAX_PUSHED_KEYS", pushed)
    monkeypatch.setattr(hb, "MAX_BROADCAST_HASHES", sent)
    first = {f"f{i}.ts": text(f"one{i}") for i in range(20)}
    later = {**{f"f{i}.ts": text(f"one{i}") for i in range(5, 20)}, **{f"g{i}.go": text(f"two{i}") for i in range(20)}}
    path = str(tmp_path / "index")
    stored = m.build_index(files(first), ENC)
    snapshots.save_index(stored, path, bitmaps=True)
    chunks = chunk_documents(files(later))
    twice = chunks.union(chunks)
    got = snapshots.insert_absent(twice, path, ENC, token="t")
    want = m.upsert_chunks(stored, twice, ENC)
    assert keys(snapshots.read_index(spark, path)) == keys(want)
    known = chunks.join(stored, "text_hash", "left_semi").count()
    assert (got.version, got.chunks, got.inserted) == (1, 2 * chunks.count(), chunks.count() - known)
    assert known <= got.possible < known + got.inserted / 2
    # The same batch again changes nothing; without its token all its hashes are found, also the delta's.
    assert snapshots.insert_absent(twice, path, ENC, token="t").version is None
    again = snapshots.insert_absent(chunks, path, ENC)
    assert (again.version, again.possible, again.inserted) == (2, chunks.count(), 0)
    assert {len(r.vector) for r in snapshots.read_index(spark, path).collect()} == {8}


def test_removed_rows_come_back_and_compaction_keeps_bitmaps(spark, files, tmp_path):
    path = str(tmp_path / "index")
    index = m.build_index(files({"a.ts": text("a"), "b.ts": text("b")}), ENC)
    snapshots.save_index(index, path, bitmaps=True)
    gone = spark.createDataFrame([("a.ts",)], "filepath string")
    snapshots.append_delta(m.empty_index(spark), gone, path)
    chunks = chunk_documents(files({"a.ts": text("a"), "b.ts": text("b")}))
    got = snapshots.insert_absent(chunks, path, ENC)
    assert got.inserted == chunks.where("filepath = 'a.ts'").count()
    assert keys(snapshots.read_index(spark, path)) == keys(index)
    snapshots.compact_index(spark, path)
    assert snapshots.read_bitmaps(spark, path) is not None
    assert snapshots.insert_absent(chunks, path, ENC).inserted == 0


def test_empty_tables_and_an_index_without_bitmaps(spark, files, tmp_path):
    chunks = chunk_documents(files({"a.ts": text("a")}))
    empty = str(tmp_path / "empty")
    snapshots.save_index(m.empty_index(spark), empty, bitmaps=True)
    assert snapshots.read_bitmaps(spark, empty)[1] == 0
    assert snapshots.insert_absent(chunks.limit(0), empty, ENC)[1:] == (0, 0, 0)
    got = snapshots.insert_absent(chunks, empty, ENC)
    assert got.possible == 0 and got.inserted == chunks.count()
    plain = str(tmp_path / "plain")
    snapshots.save_index(m.build_index(files({"b.ts": text("b")}), ENC), plain)
    assert snapshots.read_bitmaps(spark, plain) is None
    got = snapshots.insert_absent(chunks, plain, ENC)
    assert (got.possible, got.inserted) == (chunks.count(), chunks.count())
    assert snapshots.read_bitmaps(spark, plain) is None


def test_hashes_that_are_null_or_empty_are_always_new(spark, files, tmp_path):
    path = str(tmp_path / "index")
    chunks = chunk_documents(files({"a.ts": text("a")}))
    blank = chunks.limit(1).withColumn("text_hash", F.lit(""))
    snapshots.save_index(m.upsert_chunks(m.empty_index(spark), blank, ENC), path, bitmaps=True)
    both = blank.union(chunks.limit(1).withColumn("text_hash", F.lit(None).cast("string")))
    want = m.upsert_chunks(snapshots.read_index(spark, path, keep_shard=False), both, ENC)
    want = sorted(map(repr, want.select("id", "text_hash").collect()))
    assert snapshots.insert_absent(both, path, ENC).inserted == 2
    assert sorted(map(repr, snapshots.read_index(spark, path).select("id", "text_hash").collect())) == want
