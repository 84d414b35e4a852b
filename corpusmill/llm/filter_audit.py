"""How filters overlap, in every order of applying them, from sorted posting lists.

Each document gets a row number; numbers are cut into ranges of ``RANGE``. A posting row
holds, for one part and one range, the sorted numbers that fail each filter and those
labelled good or toxic. A task reads posting rows one at a time and merges their lists,
galloping: it steps over a run of one list in doubling strides up to the next number of
any other list. What a filter still removes behind a set of others is a difference, what
a set of filters removes together is a union; the sizes of both add up over ranges, and
all 120 orders follow from the 80 differences and 31 unions of a part.

Copies are found by the SHA-256 of their texts. A digest that more than one in
``HOT_SHARE`` rows have meets its rows in a broadcast (there are fewer than ``HOT_SHARE``
of those digests); the others are joined by a shuffle.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import combinations, permutations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.tables import written

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 100, 80, 10
SYMBOLS = "[#$%&*|]"
#: Row numbers of one posting row: the most that a list can hold.
RANGE = 1 << 16
HOT_SHARE = 1000
#: Posting rows that a task merges: small in bytes, long in time.
ROWS_PER_TASK = 16


def gallop(ids: Sequence[int], start: int, wanted: int) -> int:
    """The first place from ``start`` on whose id is ``wanted`` or more: doubling strides, then halving."""
    size, stride, low = len(ids), 1, start
    high = start
    while high < size and ids[high] < wanted:
        low, high = high + 1, high + stride
        stride *= 2
    return bisect_left(ids, wanted, low, min(high, size))


def union(lists: Sequence[Sequence[int]]) -> list[int]:
    """The ids of any list, each once, ascending; lists are ascending, without repeats."""
    out: list[int] = []
    places = {k: 0 for k, ids in enumerate(lists) if len(ids)}
    while places:
        first = min(places, key=lambda k: lists[k][places[k]])
        head = lists[first][places[first]]
        rest = None
        for k in list(places):
            if k == first:
                continue
            if lists[k][places[k]] == head:
                places[k] += 1
                if places[k] == len(lists[k]):
                    del places[k]
                    continue
            other = lists[k][places[k]]
            rest = other if rest is None or other < rest else rest
        ids, at = lists[first], places[first]
        end = len(ids) if rest is None else gallop(ids, at, rest)
        out += ids[at:end]
        if end == len(ids):
            del places[first]
        else:
            places[first] = end
    return out


def difference(ids: Sequence[int], others: Sequence[Sequence[int]]) -> list[int]:
    """The ids that are in no other list."""
    out: list[int] = []
    places, at = [0] * len(others), 0
    while at < len(ids):
        wanted, following = ids[at], None
        for k, other in enumerate(others):
            place = places[k] = gallop(other, places[k], wanted)
            if place < len(other) and (following is None or other[place] < following):
                following = other[place]
        if following == wanted:
            at += 1
            continue
        end = len(ids) if following is None else gallop(ids, at, following)
        out += ids[at:end]
        at = end
    return out


def shared(ids: Sequence[int], other: Sequence[int]) -> int:
    """How many ids both lists have."""
    found = at = place = 0
    while at < len(ids):
        place = gallop(other, place, ids[at])
        if place == len(other):
            break
        if other[place] == ids[at]:
            found += 1
            at += 1
        else:
            at = gallop(ids, at, other[place])
    return found


def _subsets(letters: str) -> Iterator[str]:
    for n in range(len(letters) + 1):
        yield from map("".join, combinations(letters, n))


def sizes(lists: dict[str, Sequence[int]], good: Sequence[int], toxic: Sequence[int]) -> Iterator[tuple[str, int, int, int]]:
    """(key, ids, good ones, toxic ones) of all differences and unions of the failing-id lists.

    ``"B-AC"`` names the ids of B that are in neither A nor C, ``"ABC"`` those in any of the three.
    """
    for name in FILTERS:
        for others in _subsets(FILTERS.replace(name, "")):
            left = difference(lists[name], [lists[o] for o in others])
            if left:
                yield f"{name}-{others}", len(left), shared(left, good), shared(left, toxic)
    for names in _subsets(FILTERS):
        if names and (size := len(union([lists[n] for n in names]))):
            yield names, size, 0, 0


def facts(docs: DataFrame) -> DataFrame:
    """row, doc_id, part, failed (bits of A to D), digest: one row per document.

    ``row`` depends on how the table is read: write the result before using it twice.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    checks = [
        n < MIN_WORDS,
        100 * distinct.cast("long") < MIN_DISTINCT * n.cast("long"),
        100 * (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))).cast("long") > MAX_UPPER * F.length("text").cast("long"),
        F.col("text").rlike(SYMBOLS),
    ]
    failed = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(checks)), F.lit(0))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
            .withColumn("words", words)
            .select(F.monotonically_increasing_id().alias("row"), "doc_id", "part", failed.alias("failed"), F.unhex(F.sha2("text", 256)).alias("digest")))


def copies(rows: DataFrame) -> DataFrame:
    """The rows whose text a smaller doc_id has. A null id has no smaller one and is none."""
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).filter("n > 1 and least is not null")
    hot = F.col("n") > rows.count() // HOT_SHARE
    most, some = groups.filter(hot).drop("n"), groups.filter(~hot).drop("n")
    # Fewer than HOT_SHARE digests can have more than that share of the rows each.
    known = rows.join(F.broadcast(most), "digest", "left")
    rest = known.filter("least is null").drop("least").join(some, "digest")
    return known.unionByName(rest).filter("doc_id > least").select("row", "doc_id", "part")


def postings(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, block, A to E, good, toxic: the sorted row numbers of a range that fail or are labelled.

    A document is good if any label row of its id says quality 1, toxic likewise.
    """
    marked = (labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                   F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    failing = (rows.filter("failed > 0").select("row", "doc_id", "part", "failed")
               .unionByName(copies(rows).withColumn("failed", F.lit(1 << 4)))
               .groupBy("row", "doc_id", "part").agg(F.bit_or("failed").alias("failed")))
    tests = {f: F.col("failed").bitwiseAND(1 << k) > 0 for k, f in enumerate(FILTERS)} | {"good": F.col("good"), "toxic": F.col("toxic")}
    return (failing.join(marked, "doc_id", "left")
            .groupBy("part", F.shiftright("row", RANGE.bit_length() - 1).alias("block"))
            .agg(*(F.sort_array(F.collect_list(F.when(c, F.col("row")))).alias(name) for name, c in tests.items())))


def _counted(lists: DataFrame) -> DataFrame:
    """part, key, size, good, toxic: the sizes of all differences and unions, summed over ranges."""

    def task(batches):
        for batch in batches:
            total: Counter = Counter()
            columns = {n: batch.column(n) for n in (*FILTERS, "good", "toxic")}
            for k, part in enumerate(batch.column("part").to_pylist()):
                row = {n: c[k].values.to_pylist() for n, c in columns.items()}
                for key, *counts in sizes(row, row["good"], row["toxic"]):
                    for m, count in enumerate(counts):
                        total[part, key, m] += count
            keys = sorted({(part, key) for part, key, _ in total})
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[j] for k in keys], pa.string()) for j in range(2)] + [pa.array([total[*k, m] for k in keys], pa.int64()) for m in range(3)],
                names=["part", "key", "size", "good", "toxic"])

    found = lists.mapInArrow(task, "part string, key string, size long, good long, toxic long")
    return found.groupBy("part", "key").agg(*(F.sum(c).alias(c) for c in ("size", "good", "toxic")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter does in each part, at each step of each order: 600 rows a part.

    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley. A to E: few words, few distinct words, many capitals, a symbol, a text that a
    smaller doc_id has in the whole table. A null text counts as empty, a null lang as the
    part "". Every row is a document of its own, also one whose doc_id is null (never a
    copy, without labels) or repeated (no copy of itself); null, repeated and other labels
    are ignored. Other columns are ignored. Without documents there is no part and no row;
    without labels nothing good or toxic is lost.
    """
    rows = written(facts(docs), "audit-facts")
    lists = written(postings(rows, labels), "audit-postings")
    lists = lists.repartition(max(1, -(-lists.count() // ROWS_PER_TASK)))
    counts = _counted(lists).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("size", "good", "toxic")))).alias("counts"))
    orders = F.split(F.lit(" ".join(map("".join, permutations(FILTERS)))), " ")
    steps = (rows.groupBy("part").agg(F.count("*").alias("n")).join(counts, "part", "left")
             .select("part", "n", "counts", F.explode(orders).alias("filter_order"))
             .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")))
    name = F.substring("filter_order", F.col("step"), F.lit(1))

    def letters(text):
        return F.array_join(F.array_sort(F.split(text, "")), "")

    def count(key, field="size"):
        return F.coalesce(F.col("counts")[key][field], F.lit(0).cast("long"))

    before = letters(F.substring("filter_order", F.lit(1), F.col("step") - 1))
    behind = F.concat("name", F.lit("-"), before)
    rest = F.concat("name", F.lit("-"), F.replace(F.lit(FILTERS), F.col("name"), F.lit("")))
    return (steps.withColumn("name", name)
            .select("part", "filter_order", "step", "name",
                    (F.col("n") - count(letters(F.substring("filter_order", F.lit(1), F.col("step"))))).alias("kept"),
                    count(behind).alias("removed"),
                    (count(F.concat("name", F.lit("-"))) - count(behind)).alias("redundant"),
                    count(rest).alias("unique_fails"),
                    count(behind, "good").alias("good_lost"), count(behind, "toxic").alias("toxic_lost"))
            .withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "name"))).drop("name"))
