"""Benchmark leaks: rare bigrams of the items find candidates, Smith-Waterman alignment scores them.

The test items are the query set: they are taken in blocks of bounded bytes, each block
against all documents. An alignment that reaches ``min_score`` matches at least that
share of an item's words, and no text longer than the item and the gaps this score
allows; at least ``least`` of the item's words match. The score leaves
``2 * (1 - min_score) * n`` points to lose, and no edit breaks more than one of the item's ``n - 1``
bigrams a point (an inserted word breaks one for a point, another word two for three, a missing
end one for two). So ``whole`` bigrams or more stand in the leaked passage, however it was
edited, and of any ``n - 1 - whole + k`` of them ``k`` or more. Items too short for this (5 words or fewer
at 0.6) are found by single words, of which ``least`` stand there.
Per block, a first pass counts how often each bigram of the items occurs; the rarest of an
item become its seeds. A second pass joins the documents' bigrams with the seeds by hash and
aligns the item with every passage that holds ``k`` of them, and ``least`` of its words, close enough to
each other. The seeds of a block are small and sent to the task that reads the document: no shuffle,
and nothing grows with copies.

Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import hashing as hs
from corpusmill.llm.tables import lean

MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.6  # of the score of a verbatim copy
SEEDS_A_HIT = 10  # one seed more is asked for, and taken, for so many words of an item
BLOCK_BYTES = 4 << 20  # of item texts sent to the tasks at once
SLICE_HITS = 1 << 20  # hits of whole documents that are sorted at once
_BITS = 20


class Lookup:
    """Hashes, looked up through a bitmap and then exactly."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.bitmap = np.zeros(1 << _BITS, dtype=bool)
        self.bitmap[self.hashes >> np.uint64(64 - _BITS)] = True

    def find(self, word_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word position, index of the hash) of every hit."""
        at = np.flatnonzero(self.bitmap[word_hashes >> np.uint64(64 - _BITS)])
        index = np.searchsorted(self.hashes, word_hashes[at])
        index[index == len(self.hashes)] = 0
        good = self.hashes[index] == word_hashes[at] if len(self.hashes) else np.zeros(0, dtype=bool)
        return at[good], index[good]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(best local score, end position in text) of two word sequences, linear gap cost."""
    ramp = np.arange(len(text) + 1) * -GAP
    above = np.zeros(len(text) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        row = np.zeros(len(text) + 1, np.int64)
        row[1:] = above[:-1] + np.where(text == word, MATCH, MISMATCH)
        np.maximum(row, above + GAP, out=row)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + ramp) - ramp
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
        above = row
    return best, end


def located(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(score, first word, word after the last) of the best local alignment."""
    score, end = align(item, text)
    if not score:
        return 0, 0, 0
    _, back = align(item[::-1], text[:end][::-1])
    return score, end - back, end


def _text_words(column: pa.Array):
    """Blocks (row, word hashes, bounds) of a text column."""
    data, offsets = hs.text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    for row, end in hs.row_blocks(offsets):
        low = offsets[row]
        hashes, _, bound = hs.words(data[low:offsets[end]], offsets[row:end + 1] - low, breaks=hs.letter_breaks())
        yield row, hashes, bound


def _item_words(items: list) -> list[np.ndarray]:
    column = pa.array([x["text"] for x in items], pa.string())
    return [hashes[bound[i]:bound[i + 1]] for _, hashes, bound in _text_words(column) for i in range(len(bound) - 1)]


class Matcher:
    """The items of a block with their seeds; made on the driver, used in the tasks."""

    def __init__(self, words: list[np.ndarray], min_score: float):
        self.words, self.min_score = words, min_score
        self.size = np.array([len(w) for w in words], np.int64)
        self.least = np.array([max(1, math.ceil(min_score * n - 1e-9)) for n in self.size], np.int64)
        lost = np.floor((1 - min_score) * MATCH * self.size + 1e-9).astype(np.int64)
        #: Gaps in the item that an alignment of all its words can afford.
        self.gaps = np.maximum(0, lost // -GAP)
        whole = self.size - 1 - lost
        #: Words in a seed, and how many seeds of an item stand in each leak of it.
        self.gram = np.where(whole >= 1, 2, 1)
        self.whole = np.where(whole >= 1, whole, self.least)
        self.asked = np.minimum(np.maximum(1, self.size // SEEDS_A_HIT), self.whole)
        self.grams = [hs.grams(w, int(g)) for w, g in zip(words, self.gram, strict=True)]
        self.lengths = sorted({int(g) for g, w in zip(self.gram, words, strict=True) if len(w)})
        self.seeds = Lookup(np.concatenate([np.zeros(0, np.uint64), *self.grams]))
        self.first = self.item = self.place = np.zeros(0, np.int64)

    def find(self, hashes: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, word position, index of the seed) of every seed in the texts, by position."""
        found = [self.seeds.find(hs.grams(hashes, n)) for n in self.lengths]
        at = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in found)])
        index = np.concatenate([np.zeros(0, np.int64), *(x for _, x in found)])
        last = at + np.repeat(np.array(self.lengths, np.int64), [len(x) for x, _ in found]) - 1
        doc = np.searchsorted(bound, at, side="right") - 1
        own = np.flatnonzero(last < bound[doc + 1])  # a gram over the end of a text is none
        own = own[np.argsort(at[own], kind="stable")]
        return doc[own], at[own], index[own]

    def counts(self, column: pa.Array) -> dict[int, int]:
        """How often each gram of the items occurs in the texts."""
        found: Counter[int] = Counter()
        for _, hashes, bound in _text_words(column):
            index, n = np.unique(self.find(hashes, bound)[2], return_counts=True)
            found.update(dict(zip(self.seeds.hashes[index].tolist(), n.tolist(), strict=True)))
        return found

    def choose(self, frequency: dict[int, int]) -> None:
        """Keep as seeds so many of the rarest grams of an item that each leak holds ``asked`` of them."""
        seeds = []
        for k, grams in enumerate(self.grams):
            order = sorted(range(len(grams)), key=lambda j: (frequency.get(int(grams[j]), 0), j))
            seeds += [(int(grams[j]), k, j) for j in order[:max(0, len(grams) - int(self.whole[k]) + int(self.asked[k]))]]
        seeds.sort()
        self.seeds = Lookup(np.array([x[0] for x in seeds], np.uint64))
        self.first = np.searchsorted(np.array([x[0] for x in seeds], np.uint64), self.seeds.hashes)
        self.first = np.append(self.first, len(seeds)).astype(np.int64)
        self.item, self.place = (np.array([x[i] for x in seeds], np.int64) for i in (1, 2))

    def hits(self, column: pa.Array) -> list[tuple[int, int, float, int, int]]:
        """(row, item, score, first word, word after the last): the best place of each leak."""
        out = []
        for row, hashes, bound in _text_words(column):
            for doc, item, low, high in self._passages(hashes, bound):
                own, words, best = hashes[bound[doc]:bound[doc + 1]], self.words[item], (0.0, 0, 0)
                for a, b in _joined(low, high):
                    for begin, end in self._dense(own, item, max(0, a), min(len(own), b)):
                        score, first, last = located(words, own[begin:end])
                        best = max(best, (score / (MATCH * len(words)), -begin - first, begin + last))
                if best[0] >= self.min_score:
                    out.append((row + doc, item, best[0], -best[1], best[2]))
        return out

    def _passages(self, hashes: np.ndarray, bound: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(document, item, first words, words after the last) of stretches that hold enough seeds."""
        doc, at, index = self.find(hashes, bound)
        times = self.first[index + 1] - self.first[index]
        total = np.cumsum(times)
        begin = 0
        while begin < len(at):
            end = int(np.searchsorted(total, total[begin] + SLICE_HITS))
            end = int(np.searchsorted(doc, doc[min(max(end, begin + 1), len(at)) - 1], side="right"))
            part = slice(begin, end)
            n = times[part]
            entry = np.repeat(self.first[index[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield from self._close(np.repeat(doc[part], n), self.item[entry], np.repeat(at[part], n) - bound[np.repeat(doc[part], n)],
                                   self.place[entry])
            begin = end

    def _close(self, doc: np.ndarray, item: np.ndarray, at: np.ndarray, place: np.ndarray):
        pair = doc * len(self.words) + item
        order = np.lexsort((at, pair))
        pair, item, at, place = pair[order], item[order], at[order], place[order]
        new = np.ones(len(pair), dtype=bool)
        new[1:] = (pair[1:] != pair[:-1]) | (at[1:] != at[:-1])
        own = np.flatnonzero(new)  # a text position counts once
        asked, spot = self.asked[item[own]], np.arange(len(own))
        last = np.minimum(spot + asked - 1, len(own) - 1)
        good = ((spot + asked <= len(own)) & (pair[own][last] == pair[own])
                & (at[own][last] - at[own] < (self.size + self.gaps)[item[own]]))
        step = np.zeros(len(own) + 1, np.int64)
        np.add.at(step, spot[good], 1)
        np.add.at(step, (spot + asked)[good], -1)
        live = np.flatnonzero((np.cumsum(step)[:-1] > 0)[np.cumsum(new) - 1])
        pair, item = pair[live], item[live]
        low = at[live] - place[live] - self.gaps[item]
        high = at[live] - place[live] + self.size[item] + self.gaps[item]
        cut = np.append(np.flatnonzero(np.append(True, pair[1:] != pair[:-1])), len(pair)) if len(pair) else [0]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield int(pair[a]) // len(self.words), int(item[a]), low[a:b], high[a:b]

    def _dense(self, own: np.ndarray, item: int, low: int, high: int) -> Iterator[tuple[int, int]]:
        """Stretches within own[low:high] that hold as many words of the item as an alignment must match."""
        words, least, span = self.words[item], int(self.least[item]), int(self.size[item] + self.gaps[item])
        at = np.flatnonzero(np.isin(own[low:high], words))
        if len(at) < least or np.isin(words, own[low:high]).sum() < least:
            return
        start = at[:len(at) - least + 1]
        start = start[at[least - 1:] - start < span] + low
        for begin, end in _joined(start, start + span):
            yield begin, min(high, end)


def _joined(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of a text in order, joined where they meet."""
    if not len(low):
        return
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    cut = np.flatnonzero(low[1:] > high[:-1]) + 1
    for a, b in zip(np.append(0, cut), np.append(cut, len(low)), strict=True):
        yield int(low[a]), int(high[b - 1])


def _matchers(docs: DataFrame, items: DataFrame, min_score: float, block_bytes: int):
    """(item ids, matcher) per block of items; one counting pass over the documents each."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))
    for k in range(blocks):
        # Of bounded size: the hash deals the items evenly over the blocks.
        own = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        matcher = Matcher(_item_words(own), min_score)

        def count(batches, matcher=matcher):
            for batch in batches:
                found = matcher.counts(batch.column(0))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.array(list(found), np.uint64).view(np.int64)), pa.array(found.values(), pa.int64())], names=["hash", "n"])

        rows = (texts.mapInArrow(lean(count), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
                .collect() if any(len(w) for w in matcher.words) else [])
        matcher.choose({r["hash"] % (1 << 64): r["n"] for r in rows})
        yield [x["item_id"] for x in own], matcher


def leaks(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word) of each document that holds a test item.

    ``score`` is the best local alignment score (match 2, mismatch and gap -1) over that
    of a verbatim copy; all pairs that reach ``min_score`` are found, the others left out. Word positions count the
    words of the document; of equal scores the last end wins. Null or empty texts and
    items without words match nothing; items repeated with the same id and text count
    once; each document row is answered for itself, also with a null or repeated doc_id.
    Empty tables give an empty result; other columns are ignored.
    """
    schema = "doc_id long, item_id long, score double, first_word long, end_word long"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    result = None
    for ids, matcher in _matchers(docs, items, min_score, block_bytes):

        def search(batches, ids=ids, matcher=matcher):
            for batch in batches:
                found = matcher.hits(batch.column(1))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array([x[0] for x in found], pa.int64())),
                    pa.array([ids[x[1]] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.float64()),
                    pa.array([x[3] for x in found], pa.int64()), pa.array([x[4] for x in found], pa.int64())],
                    names=["doc_id", "item_id", "score", "first_word", "end_word"])

        part = texts.mapInArrow(lean(search), schema)
        result = part if result is None else result.union(part)
    return result


def without_leaks(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no test item, with all their columns; no shuffle."""
    column = docs.columns.index("text")
    for _, matcher in _matchers(docs, items, min_score, block_bytes):

        def clean(batches, matcher=matcher):
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[x[0] for x in matcher.hits(batch.column(column))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(lean(clean), docs.schema)
    return docs
