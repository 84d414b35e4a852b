"""Token counts that follow edits.

A text is cut into pre-tokens by the tokenizer's pattern. A segment tree over them keeps
characters and tokens of every subtree. An edit replaces a character range: the tree
finds the pre-tokens it touches; they are cut and encoded anew together with the context
before them, and onwards until a new cut falls on an old one behind the edit, from where
everything stays as it was. The new pre-tokens are dealt over the leaves they replace,
and the sums on the paths to the root are updated.

The pattern may look ahead but not back, so a pre-token depends on the text from its
start on: two pre-tokens of context before the edit are enough, as none looks more than
two characters beyond its end.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTEXT = 2
CACHE = 500_000

Edit = tuple[int, int, str]


class Tokenizer:
    """Pre-tokens of a text and the number of tokens of each, remembered up to a bound."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        found = self.known.get(piece)
        if found is None:
            found = len(self.encoding.encode_ordinary(piece))
            if len(self.known) >= CACHE:
                self.known.clear()
            if len(piece) <= 64:
                self.known[piece] = found
        return found


class CountTree:
    """A segment tree over the pre-tokens of one text."""

    def __init__(self, text: str, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        pieces = tokenizer.cut(text)
        self.base = text
        self.leaves = len(pieces)
        self.width = 1 << max(0, (self.leaves - 1).bit_length())
        self.chars = self._built(np.fromiter(map(len, pieces), np.int64, self.leaves))
        known, count = tokenizer.known.get, tokenizer.count
        self.tokens = self._built(np.fromiter((known(p) or count(p) for p in pieces), np.int64, self.leaves))
        self.start = np.cumsum(self.chars[self.width:self.width + self.leaves]) - self.chars[self.width:self.width + self.leaves]
        self.patches: dict[int, str] = {}  # texts of changed leaves
        self.encoded = 0  # pre-tokens encoded for edits so far

    def _built(self, values: np.ndarray) -> np.ndarray:
        tree = np.zeros(2 * self.width, np.int64)
        tree[self.width:self.width + len(values)] = values
        size = self.width
        while size > 1:
            half = size // 2
            tree[half:size] = tree[size:2 * size].reshape(-1, 2).sum(axis=1)
            size = half
        return tree

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def length(self) -> int:
        return int(self.chars[1])

    def leaf_text(self, leaf: int) -> str:
        if leaf in self.patches:
            return self.patches[leaf]
        at = int(self.start[leaf])
        return self.base[at:at + int(self.chars[self.width + leaf])]

    def text(self) -> str:
        return "".join(self.leaf_text(k) for k in range(self.leaves))

    def _find(self, position: int) -> tuple[int, int]:
        """(leaf, its start) that holds a character position; the end belongs to the last leaf."""
        node, start = 1, 0
        while node < self.width:
            left = int(self.chars[2 * node])
            if position < start + left:
                node = 2 * node
            else:
                start += left
                node = 2 * node + 1
        return min(node - self.width, self.leaves - 1), start

    def _beside(self, leaf: int, step: int) -> int | None:
        """The next leaf with characters in a direction."""
        leaf += step
        while 0 <= leaf < self.leaves:
            if self.chars[self.width + leaf]:
                return leaf
            leaf += step
        return None

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.patches[leaf] = text
        node = self.width + leaf
        more_chars, more_tokens = len(text) - int(self.chars[node]), tokens - int(self.tokens[node])
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace the characters from ``start`` to ``end`` of the text as it stands."""
        if not 0 <= start <= end <= self.length:
            raise ValueError(f"edit {start}:{end} outside a text of {self.length} characters")
        if not self.leaves:
            self.__init__(replacement, self.tokenizer)
            self.encoded += self.leaves
            return
        first, at = self._find(min(start, max(0, self.length - 1)))
        for _ in range(CONTEXT):
            before = self._beside(first, -1)
            if before is None:
                break
            first = before
            at -= int(self.chars[self.width + first])
        # Old cuts behind the edit, as places in the new text from ``at`` on.
        leaves, parts, cuts, stop, shift = [], [], [], at, len(replacement) - (end - start)
        leaf, wanted = first, 2 * CONTEXT + 1
        while True:
            while leaf is not None and (stop < end or len(cuts) < wanted):
                leaves.append(leaf)
                parts.append(self.leaf_text(leaf))
                stop += len(parts[-1])
                leaf = self._beside(leaf, 1)
                if stop >= end:
                    cuts.append((stop + shift - at, len(leaves)))
            old = "".join(parts)
            new = old[:start - at] + replacement + old[end - at:]
            pieces = self.tokenizer.cut(new)
            found = self._meeting(np.cumsum([len(p) for p in pieces]), cuts, len(new), leaf is None)
            if found is not None:
                count, used = found
                pieces, leaves = pieces[:count], leaves[:used]
                break
            wanted *= 2  # so that the work stays in proportion to what changes
        self.encoded += len(pieces)
        # Dealt over the leaves they replace, so that none grows with further edits beside it.
        share = -(-len(pieces) // len(leaves))
        for k, leaf in enumerate(leaves):
            part = pieces[k * share:(k + 1) * share]
            self._set(leaf, "".join(part), sum(map(self.tokenizer.count, part)))

    @staticmethod
    def _meeting(ends: np.ndarray, cuts: list[tuple[int, int]], size: int, ended: bool) -> tuple[int, int] | None:
        """(new pieces, old leaves) up to the first common cut that does not hang on missing text."""
        place = {int(e): k + 1 for k, e in enumerate(ends)}
        place[0] = 0
        for cut, used in cuts:
            if cut in place and (ended and cut == size or place[cut] + CONTEXT <= len(ends)):
                return place[cut], used
        return (len(ends), cuts[-1][1]) if ended else None


# What an edit batch redacts here: mail and network addresses, long digit runs, secrets.
SENSITIVE = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b\d{9,}\b|\b[0-9a-f]{32,}\b")


def redactions(text: str) -> Iterator[Edit]:
    """Edits that blank sensitive strings, last first, so that places stay valid."""
    for found in reversed(list(SENSITIVE.finditer(text))):
        yield found.start(), found.end(), "[REDACTED]"


def counted(docs: DataFrame, edits: Callable[[str], Iterator[Edit]] = redactions, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token counts of each document before and after its edits.

    doc_id, n_pretokens, n_tokens, n_edits, n_reencoded (pre-tokens encoded for the
    edits), n_tokens_edited. ``edits`` maps a text to (start, end, replacement) in code
    points, each against the text as the edits before it left it. A null text counts as
    empty: no tokens, no edits. Repeated rows and null ids are counted like any other;
    other columns are ignored. The vocabulary file is read once, by the driver.
    """
    with open(vocabulary, "rb") as file:
        data = file.read()
    names = ("n_pretokens", "n_tokens", "n_edits", "n_reencoded", "n_tokens_edited")

    def task(batches):
        tokenizer = Tokenizer(data)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                tree = CountTree(text, tokenizer)
                before, leaves, n = tree.total, tree.leaves, 0
                for edit in edits(text):
                    tree.edit(*edit)
                    n += 1
                rows.append((leaves, before, n, tree.encoded, tree.total))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(5))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        task, "doc_id long, " + ", ".join(f"{n} long" for n in names))
