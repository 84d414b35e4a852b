"""Near-duplicate documents: universal hash minima, banding, verified links, components.

1. One pass hashes each text's set of word shingles, takes the minimum of each of
   ``bands * rows`` universal hash functions over the set, and keys its bands.
2. Texts with the same word sequence are one node, named by their least id.
3. Within a band key every node is paired with the least node only, so a key shared by
   thousands makes thousands of pairs and not their square. Signatures rank a node's
   pairs; the best one is verified first, on the full shingle sets.
4. Large-star and small-star steps join the verified links to components.
5. Keys whose nodes are still in several components are searched completely: their
   nodes are cut into blocks, and each task compares two blocks on the full sets,
   skipping what is already connected and returning links of a spanning forest only.
   No link between different texts of a shared key is lost, and no pairs are stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import hashing as hs
from corpusmill.llm.components import components
from corpusmill.llm.tables import discard, lean, written

BANDS, ROWS = 32, 4
SHINGLE = 5
THRESHOLD = 80  # percent
SLACK = 0.25
BLOCK = 512  # nodes in a block of step 5
#: Ids up to this many (8 bytes each) are sent to the scan; beyond it the join shuffles.
MAX_BROADCAST_IDS = 2_000_000


def shingle_set(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than ``size`` make one shingle."""
    if not len(word_hashes):
        return word_hashes
    return np.unique(hs.grams(word_hashes, min(size, len(word_hashes))))


def hash_functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed multiply-shift functions x -> (a * x + b) >> 32, a odd."""
    seeds = hs.mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return seeds[:count] | np.uint64(1), seeds[count:]


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over a set, taken in slices of bounded memory."""
    low = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = a[:, None] * shingles[None, at:at + 2048]
        part += b[:, None]
        part >>= np.uint64(32)
        np.minimum(low, part.min(axis=1), out=low)
    return low.astype(np.uint32)


def _sets(batch: pa.RecordBatch, column: int, shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, offsets = hs.text_bytes(batch.column(column))
    for row, end in hs.row_blocks(offsets):
        low = offsets[row]
        hashes, _, bound = hs.words(
            data[low:offsets[end]], offsets[row:end + 1] - low, fold=True)
        for i in range(row, end):
            own = hashes[bound[i - row]:bound[i - row + 1]]
            yield i, own, shingle_set(own, shingle)


def signatures(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, key1, key2, signature, band) per document; the keys hash the words."""
    a, b = hash_functions(bands * rows)

    def task(batches):
        for batch in batches:
            out = {"n": [], "k1": [], "k2": [], "sig": [], "band": []}
            for _, own, shingles in _sets(batch, 1, shingle):
                k1, k2 = hs.sequence_hash(own)
                low = minima(shingles, a, b)
                out["n"].append(len(shingles))
                out["k1"].append(k1)
                out["k2"].append(k2)
                out["sig"].append(low.tobytes() if len(own) else None)
                out["band"].append(
                    hs.grams_of_rows(low.reshape(bands, rows)).view(np.int64) if len(own) else None)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(out["n"], pa.int64()), pa.array(out["k1"], pa.int64()),
                pa.array(out["k2"], pa.int64()), pa.array(out["sig"], pa.binary()),
                pa.array(out["band"], pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "key1", "key2", "signature", "band"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lean(task), "doc_id long, n_shingles long, key1 long, key2 long, signature binary, band array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the documents named by ``ids`` (a written table of column node)."""
    wanted = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids

    def task(batches):
        for batch in batches:
            sets = [shingles.tobytes() for _, _, shingles in _sets(batch, 1, shingle)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return (docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
            .join(wanted, "node", "left_semi").mapInArrow(lean(task), "node long, shingles binary"))


def agreeing(one: np.ndarray, many: np.ndarray, threshold: int) -> np.ndarray:
    """Signatures that agree well enough with one to be looked at.

    A pair at the threshold agrees on that share of the minima on average; SLACK less is
    some seven standard deviations away for 128 minima.
    """
    return (many == one).mean(axis=1) >= threshold / 100 - SLACK


def similar(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """100 * |x & y| >= threshold * |x | y| for sorted distinct arrays."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or 100 * len(small) < threshold * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    shared = int(np.count_nonzero(large[at] == small))
    return 100 * shared >= threshold * (len(x) + len(y) - shared)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def task(batches):
        for batch in batches:
            keep = []
            for x, y, u, v in zip(*(batch.column(c) for c in ("one", "two", "sign_one", "sign_two")), strict=True):
                u, v = np.frombuffer(u.as_py(), np.uint32), np.frombuffer(v.as_py(), np.uint32)
                keep.append(bool(agreeing(u, v[None], threshold)[0]) and similar(
                    np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def side(node: str, name: str) -> DataFrame:
        return sets.select(F.col("node").alias(node), F.col("shingles").alias(name), F.col("signature").alias(f"sign_{name}"))

    return (pairs.join(side("b", "two"), "b").join(side("a", "one"), "a")
            .select("a", "b", "one", "two", "sign_one", "sign_two").mapInArrow(task, "a long, b long"))


def _tile_links(open_nodes: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links between the nodes of each key, from block pairs; open_nodes: key, node, component, blocks."""
    placed = (open_nodes
              .withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                      "node", "component"))

    def task(table: pa.Table) -> pa.Table:
        nodes, comps = table["node"].to_pylist(), table["component"].to_pylist()
        found = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        signs = np.stack([np.frombuffer(x, np.uint32) for x in table["signature"].to_pylist()])
        order = np.array(sorted(range(len(nodes)), key=lambda i: (len(found[i]), nodes[i])))
        root = {c: c for c in comps}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        links = []
        for k, i in enumerate(order):
            later = order[k + 1:]
            for j in later[agreeing(signs[i], signs[later], threshold)]:
                x, y = find(comps[i]), find(comps[j])
                if x != y and similar(found[i], found[j], threshold):
                    root[x] = y
                    links.append((nodes[i], nodes[j]))
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return (placed.join(sets, "node").select("key", "low", "high", "node", "component", "shingles", "signature")
            .groupBy("key", "low", "high").applyInArrow(task, "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD,
                    bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id reachable), kept.

    Words are lower-cased (A-Z) runs of bytes other than 0x20 and 0x09-0x0D; a text of
    fewer than ``shingle`` words counts as one shingle. Texts that are null or have no
    word are linked with nothing. A row with a null doc_id takes part in no link, has a
    null component and is kept. Rows with one doc_id are one node: links of any of their
    texts count (for the full sets, each text is tried). Ties need no rule: the result depends on the
    links alone. Other columns of ``docs`` are ignored. A pair at the threshold is missed
    by all bands with probability (1 - 0.8**rows)**bands, 5e-8 by default.
    """
    signed = written(signatures(docs, shingle, bands, rows), "minhash")
    texts = signed.filter("doc_id is not null and signature is not null")
    named = texts.groupBy("key1", "key2").agg(
        F.min("doc_id").alias("node"), F.first("signature").alias("signature"), F.first("band").alias("band"))
    named = written(named, "minhash-nodes")
    same = (texts.select("doc_id", "key1", "key2").join(named.select("key1", "key2", "node"), ["key1", "key2"])
            .select("doc_id", "node"))
    keyed = named.select("node", "signature", F.posexplode("band").alias("number", "value")).select(
        "node", "signature", F.xxhash64("number", "value").alias("key"))
    heads = keyed.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = written(keyed.join(heads, "key").select("key", F.col("node").alias("b"), "a"), "minhash-keys")
    pairs = stars.filter("a <> b").groupBy("b", "a").agg(F.count("*").alias("n"))
    best = written(pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")), "minhash-best")
    # Every node that shares a key: step 5 also compares those that are in no best pair.
    ids = written(stars.select(F.col("b").alias("node")).distinct(), "minhash-ids")
    sets = written(full_sets(docs, ids, shingle).join(named.select("node", "signature"), "node"), "minhash-sets")
    links = written(_verified(best, sets, threshold), "minhash-links")
    first = written(components(links), "minhash-first")

    members = stars.select("key", F.col("b").alias("node")).join(first, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component"))
    # Of keys with the same nodes, as most keys of two near documents are, one is searched.
    mixed = members.groupBy("key").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("node")).alias("one"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("two")).filter("x <> y")
    searched = mixed.groupBy("n", "one", "two").agg(F.min("key").alias("key"))
    # The count per key comes with it: no later step needs a key's nodes in one task.
    open_nodes = members.join(searched.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "key")
    more = written(_tile_links(open_nodes, sets, threshold), "minhash-more")
    found = components(links.union(more).union(_shared_ids(same)))
    discard(stars, best, ids, sets, links, first, more)
    return _labelled(signed, same, found)


def _shared_ids(same: DataFrame) -> DataFrame:
    """Links between the nodes to which one repeated doc_id belongs."""
    several = same.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b")
    return same.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b"))


def _labelled(signed: DataFrame, same: DataFrame, found: DataFrame) -> DataFrame:
    own = (same.join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
           .groupBy("doc_id").agg(F.min("component").alias("component_id")))
    return (signed.select("doc_id", "n_shingles").join(own, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
