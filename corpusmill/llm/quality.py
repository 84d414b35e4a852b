"""Quality by a hashed n-gram log-likelihood ratio, after rules on counts and repeats.

Texts are cut into runs of letters and digits and runs of punctuation, lower-cased; their
unigrams and bigrams are hashed into ``BUCKETS`` classes. One multinomial over the
classes is counted over all documents (raw), one over all documents labelled good and
not toxic (trusted). A document's score is the log-likelihood ratio of the two, divided
by the number of its n-grams. The threshold is fixed once per fit, from exact order
statistics of the scores of all labelled documents; every document above it is kept,
without any draw.

Counting and scoring return class counts, or a row per document. Up to
``MAX_BROADCAST_IDS`` labelled ids meet the texts in the scan; more of them meet them by
one shuffle of the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import hashing as hs
from corpusmill.llm.tables import discard, written

BUCKETS = 10_000
#: Labelled ids that are broadcast, after a count; beyond it the texts are shuffled.
MAX_BROADCAST_IDS = 200_000
#: Scores that are sorted in one place, and ranges that more of them are counted in.
SORTED, RANGES = 10_000, 1024
#: Weight of the raw distribution in the trusted one, in n-grams per class.
PRIOR = 1.0
#: Part of the trusted documents that the threshold may reject.
LOSS = 0.001
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"


def _classes() -> np.ndarray:
    """0 between words, 1 letters and digits, 2 punctuation."""
    table = np.where(hs.letter_breaks(), 2, 1).astype(np.uint8)
    table[hs.space_table()] = 0
    table[:32][~hs.space_table()[:32]] = 2
    return table


def gram_classes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unigram and bigram, bounds per text); bigrams stay within a text."""
    kind = _classes()[data]
    first = kind > 0
    if len(data):
        first[1:] &= kind[1:] != kind[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = kind[inner] > 0
    starts = np.flatnonzero(first)
    bound = np.searchsorted(starts, offsets)
    values = hs.byte_values()[hs.lower_table()]
    values[hs.space_table()] = 0
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        begin = starts[at]
        end = int(np.searchsorted(starts, begin + hs.PIECE_BYTES, side="right"))
        stop = len(data) if end >= len(starts) else starts[end]
        hashes[at:end] = hs.segment_hashes(data[begin:stop], starts[at:end] - begin, values)
        at = end
    classes = np.empty((len(hashes), 2), np.int64)
    classes[:, 0] = hashes % np.uint64(BUCKETS)
    classes[:, 1] = -1
    two = hs.grams(hashes, 2)
    classes[1:, 1] = two % np.uint64(BUCKETS)
    classes[bound[:-1][bound[:-1] < len(hashes)], 1] = -1  # the first of a text ends no bigram
    keep = classes.ravel() >= 0
    count = np.concatenate([[0], np.cumsum(keep)])
    return classes.ravel()[keep], count[2 * bound]


def scores(column: pa.Array, ratio: np.ndarray) -> np.ndarray:
    """Mean log ratio of each text's n-grams; 0 for a text without any."""
    data, offsets = hs.text_bytes(column)
    out = np.zeros(len(offsets) - 1)
    for row, end in hs.row_blocks(offsets):
        low = offsets[row]
        classes, bound = gram_classes(data[low:offsets[end]], offsets[row:end + 1] - low)
        total = np.concatenate([[0.0], np.cumsum(ratio[classes])])
        count = np.diff(bound)
        out[row:end] = (total[bound[1:]] - total[bound[:-1]]) / np.maximum(1, count)
    return out


def rules(text: bytes) -> tuple[int, int, int, int, int]:
    """(words, word characters, symbols, repeated lines, words in repeated 3-word windows)."""
    words = text.split()
    chars = len(text.translate(None, _NO_CHARS))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeated = 0
    if len(words) >= 4:
        seen: dict[tuple, int] = {}
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            again = bytearray(len(words))
            for i, window in enumerate(windows):
                j = seen.setdefault(window, i)
                if j != i:
                    again[j:j + 3] = again[i:i + 3] = b"\1\1\1"
            repeated = sum(again)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


#: Bytes between words, and continuation bytes of UTF-8, which are no code points of their own.
_NO_CHARS = b" \t\n\x0b\f\r" + bytes(range(0x80, 0xC0))


class Model:
    def __init__(self, ratio: np.ndarray, threshold: float):
        self.ratio, self.threshold = ratio, threshold


def _class_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each class occurs in the texts, and in those with a true ``trusted``; tasks send one array of counts each."""

    def count(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            data, offsets = hs.text_bytes(batch.column(0))
            trusted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for row, end in hs.row_blocks(offsets):
                low = offsets[row]
                classes, bound = gram_classes(data[low:offsets[end]], offsets[row:end + 1] - low)
                own = classes[np.repeat(trusted[row:end], np.diff(bound))]
                total += [np.bincount(x, minlength=BUCKETS) for x in (classes, own)]
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(n[used], pa.int64()) for n in total)], names=["class", "raw", "trusted"])

    found = np.zeros((2, BUCKETS))
    counted = docs.select(F.col("text").cast("string"), "trusted").mapInArrow(count, "class int, raw long, trusted long")
    for r in counted.groupBy("class").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).collect():
        found[:, r["class"]] = r["raw"], r["trusted"]
    return found[0], found[1]


def _sides(labels: DataFrame) -> DataFrame:
    """Every id that labels agree on, with side 1 (trusted) or 0."""
    side = F.when((F.min("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) != 1), 1).when(F.max("quality") == 0, 0)
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(side.alias("side"))
    return known.filter("side is not null")


def fit(docs: DataFrame, labels: DataFrame, loss: float = LOSS) -> Model | None:
    """Fit on all documents and all labels.

    Trusted is quality 1 and toxic not 1; labels that contradict each other for an id, null
    ids and null qualities are left out. None without a trusted label.
    """
    known = written(_sides(labels), "quality-sides")
    try:
        if known.filter("side = 1").isEmpty():
            return None
        few = known.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
        # The texts are streamed past the ids of their partition: neither side is sorted.
        side = F.broadcast(known) if few else known.hint("shuffle_hash")
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        # Null ids match nothing, and a second key keeps them from one task.
        spread = texts.withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0))
        marked = spread.join(side.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left")
        raw, trusted = _class_counts(marked.withColumn("trusted", F.coalesce(F.col("side") == 1, F.lit(False))))
        base = (raw + 1) / (raw.sum() + BUCKETS)
        model = Model(np.log((trusted + PRIOR * BUCKETS * base) / (trusted.sum() + PRIOR * BUCKETS)) - np.log(base), 0.0)
        own = written(_scored(texts.filter("doc_id is not null"), model).join(side, "doc_id").select("side", "score"), "quality-scores")
        try:
            model.threshold = _cut(own, loss)
        finally:
            discard(own)
    finally:
        discard(known)
    return model


def at_ranks(scores: DataFrame, ranks: list[int]) -> list[float]:
    """The scores with these numbers, from 0, in rising order: exactly, however many there are.

    Scores are counted in ranges of equal width; the range that holds a number is cut again
    until it has one value, or few enough to be sorted in one place.
    """
    found = []
    for rank in ranks:
        part = scores.select("score")
        low, high, n = part.agg(F.min("score"), F.max("score"), F.count("score")).first()
        while low < high and n > SORTED:
            place = F.least(F.floor((F.col("score") - low) / (high - low) * RANGES), F.lit(RANGES - 1))
            ranges = part.groupBy(place.alias("place")).agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("n"))
            for r in sorted(ranges.collect(), key=lambda r: r["place"]):
                if rank < r["n"]:
                    low, high, n = r["low"], r["high"], r["n"]
                    break
                rank -= r["n"]
            part = scores.select("score").filter(F.col("score").between(low, high))
        found.append(low if low == high else sorted(r[0] for r in part.collect())[rank])
    return found


def _cut(own: DataFrame, loss: float) -> float:
    """:func:`threshold` of a table with side 1 and 0."""
    sides = {s: own.filter(F.col("side") == s) for s in (0, 1)}
    n = sides[1].count()
    if not n:
        return -np.inf
    limit = at_ranks(sides[1], [min(n - 1, int(loss * n))])[0]
    below = sides[0].filter(F.col("score") < limit)
    n = below.count()
    return limit if not n else (limit + float(np.mean(at_ranks(below, sorted({(n - 1) // 2, n // 2}))))) / 2


def threshold(trusted: np.ndarray, other: np.ndarray, loss: float) -> float:
    """The cut that loses at most ``loss`` of the trusted scores; within that, halfway to the other side."""
    if not len(trusted):
        return -np.inf
    limit = float(trusted[min(len(trusted) - 1, int(loss * len(trusted)))])
    below = other[other < limit]
    return limit if not len(below) else (limit + float(np.median(below))) / 2


def _scored(texts: DataFrame, model: Model) -> DataFrame:
    def task(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1), model.ratio))], names=["doc_id", "score"])

    return texts.select("doc_id", "text").mapInArrow(task, "doc_id long, score double")


def judge(docs: DataFrame, model: Model | None) -> DataFrame:
    """Counts, rules, score and verdict of every document.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    score, kept. Words are runs of bytes other than 0x20 and 0x09-0x0D; a null text has
    none. base_failed: fewer than 50 words, or more than half of them in repeated 3-word
    windows. kept: not base_failed and a score of the threshold or more (without a model,
    every document that passes the rules). A score equal to the threshold is kept.
    Repeated rows and null ids are judged like any other; other columns are ignored.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def task(batches):
        for batch in batches:
            counts = np.array([rules(x.as_py() or b"") for x in batch.column(1).cast(pa.binary())], np.int64).reshape(-1, 5)
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEATED * counts[:, 0])
            score = scores(batch.column(1), model.ratio) if model else np.zeros(batch.num_rows)
            kept = ~failed & (score >= (model.threshold if model else -np.inf))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[:, k]) for k in range(5)), pa.array(failed), pa.array(score), pa.array(kept)],
                names=["doc_id", *names, "base_failed", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        task, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")
