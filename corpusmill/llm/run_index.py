"""A run-length index of byte strings: run-compressed BWT with samples at run ends.

``RunIndex`` holds the Burrows-Wheeler transform of a collection of strings as runs
(start, byte, where the run maps to) and, at the end of each run, the sampled text
position. Strings are streamed through it from right to left, all of them at once: each
step is one LF mapping on runs. The matching statistic asked for is whether the next
``length`` bytes also stand in a string of a smaller document; rows whose suffixes agree
on that many bytes are neighbours, so one minimum per such group answers it.
"""

from __future__ import annotations

import numpy as np


_FIRST = 7  # characters of 9 bits that fit into one 64-bit number


def suffix_order(text: np.ndarray, left: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(suffix array, [(characters, rank by so many)]) of strings laid end to end.

    ``text`` is byte + 1, and 0 where a string ends; ``left`` the characters up to that
    end, ``owner`` the number of the string. Ends sort before bytes and by string, so no
    comparison runs into the next string. Ranks by 7 characters are doubled until every
    suffix has its own, or its string has ended.
    """
    n = len(text)
    packed = np.zeros(n, np.uint64)
    for j in range(_FIRST):
        part = text[j:].astype(np.uint64) << np.uint64(9 * (_FIRST - 1 - j))
        part[left[:n - j] < j] = 0
        packed[:n - j] += part
    ended = np.where(left < _FIRST, owner + 1, 0)

    def ranked(order: np.ndarray, new: np.ndarray) -> np.ndarray:
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        return rank

    order = np.lexsort((ended, packed))
    new = np.ones(n, bool)
    new[1:] = (packed[order][1:] != packed[order][:-1]) | (ended[order][1:] != ended[order][:-1])
    rank, have = ranked(order, new), _FIRST
    ranks = [(have, rank)]
    while have <= int(left.max()) and rank.max() < n - 1:
        second = np.zeros(n, np.int64)
        second[:max(0, n - have)] = rank[have:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key)
        new[1:] = key[order][1:] != key[order][:-1]
        rank, have = ranked(order, new), 2 * have
        ranks.append((have, rank))
    return order, ranks


class RunIndex:
    def __init__(self, strings: list[np.ndarray], docs: np.ndarray, length: int):
        """``strings`` are byte arrays, ``docs`` their document ids, ``length`` the match length."""
        self.sizes = np.array([len(s) for s in strings])
        self.ends = np.cumsum(self.sizes + 1) - 1  # where each string's terminator stands
        text = np.zeros(int(self.ends[-1]) + 1, np.int64)
        body = np.ones(len(text), bool)
        body[self.ends] = False
        text[body] = np.concatenate(strings).astype(np.int64) + 1
        owner = np.repeat(np.arange(len(strings)), self.sizes + 1)
        order, ranks = suffix_order(text, self.ends[owner] - np.arange(len(text)), owner)
        # Groups of suffixes that agree on ``length`` characters, all inside their string.
        have, rank = max((x for x in ranks if x[0] <= length), key=lambda x: x[0])
        ahead = np.zeros(len(text), np.int64)
        ahead[:max(0, len(text) - (length - have))] = rank[length - have:]
        one, two = rank[order], ahead[order]
        new = np.ones(len(order), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        start = np.flatnonzero(new)
        self.group_start = start
        self.group_least = np.minimum.reduceat(docs[owner[order]], start)
        # The transform, as runs. No row is mapped back beyond its string.
        before = text[order - 1]
        cut = np.ones(len(order), bool)
        cut[1:] = before[1:] != before[:-1]
        cut[before == 0] = True
        self.run_start = np.flatnonzero(cut)
        self.run_byte = before[self.run_start]
        run_size = np.diff(np.append(self.run_start, len(order)))
        self.run_end_sample = order[self.run_start + run_size - 1]
        by_byte = np.argsort(self.run_byte, kind="stable")
        self.run_to = np.empty(len(by_byte), np.int64)
        self.run_to[by_byte] = np.cumsum(run_size[by_byte]) - run_size[by_byte]
        first = np.empty(len(order), np.int64)
        first[order] = np.arange(len(order))
        self.terminator_row = first[self.ends]

    def back(self, row: np.ndarray) -> np.ndarray:
        """LF mapping: the row of the suffix one byte longer."""
        run = np.searchsorted(self.run_start, row, side="right") - 1
        return self.run_to[run] + row - self.run_start[run]

    def marks(self, docs: np.ndarray, length: int) -> list[np.ndarray]:
        """For each string, at which starts a match of ``length`` with a smaller document begins."""
        out = [np.zeros(max(0, int(n) - length + 1), bool) for n in self.sizes]
        by_size = np.argsort(-self.sizes, kind="stable")
        row = self.terminator_row[by_size]
        sizes = self.sizes[by_size]
        found = np.zeros((len(sizes), int(sizes.max()) + 1 if len(sizes) else 1), bool)
        for step in range(1, int(sizes.max()) + 1 if len(sizes) else 0):
            active = int(np.searchsorted(-sizes, -step, side="right"))
            row = self.back(row[:active])
            if step >= length:
                group = np.searchsorted(self.group_start, row, side="right") - 1
                found[:active, step] = self.group_least[group] < docs[by_size[:active]]
        for i, k in enumerate(by_size):
            n = int(self.sizes[k])
            if n >= length:
                out[k] = found[i, n - np.arange(n - length + 1)]
        return out
