"""Language of texts and of their words: a linear-chain conditional random field.

A word is a run of letters; a chain is a line of a text. A word's features are its
character bigrams and trigrams with word boundaries, its prefixes and suffixes of 2 to 4
letters, and the word itself (the lexicon), all hashed into one weight table. Transition
weights between the labels of neighbouring words are learned with them. The posterior
of each word comes from forward-backward; a text's label is the one with the largest
mean posterior over its words, and that mean is its score.

The model is fitted on a bounded sample of labelled texts, cut into runs of words that
are joined to code-switched sequences, so that transitions see changes of language.
Prediction reads whole texts, many chains at a time, in the task that scanned them.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import hashing as hs
from corpusmill.llm.tables import lean

#: The sample: texts per label, and the longest text (in characters) that it takes.
TRAIN_TEXTS, TRAIN_CHARS = 250, 20_000
#: Words of a sample text that are used, and words in a training sequence and its runs.
TRAIN_WORDS, SEQUENCE, RUN = 60, 40, 12
TABLE_BITS = 18
ROUNDS = 40
PENALTY = 1e-4
MIN_SCORE = 0.5
UNKNOWN = "und"
#: Characters taken at once; a longer line is taken whole.
PIECE_CHARS = 200_000


def in_training(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) != 2


class Words:
    """The words of a piece of text: bounds, chain and feature numbers."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        present = np.flatnonzero(np.bincount(codes)) if len(codes) else np.zeros(0, np.int64)
        kind = np.zeros(int(present[-1]) + 1 if len(present) else 1, np.uint64)
        proper = np.zeros(len(kind), bool)
        for c in present.tolist():
            category = unicodedata.category(chr(c))[0]
            if category in "LM":
                lower = chr(c).lower()
                kind[c] = ord(lower) if len(lower) == 1 else c
                proper[c] = category == "L"
        self.letters = int(proper[codes].sum())
        self.chars = np.concatenate([np.zeros(4, np.uint64), kind[codes], np.zeros(4, np.uint64)])
        inside = self.chars > 0
        edge = np.diff(inside.astype(np.int8))
        self.start = np.flatnonzero(edge == 1) + 1
        self.end = np.flatnonzero(edge == -1) + 1
        lines = np.flatnonzero(codes == 10) + 4
        self.line = np.searchsorted(lines, self.start)

    def features(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(per letter: 2 numbers; per word: 7 numbers) of rows in the weight table."""
        c, inside = self.chars, np.flatnonzero(self.chars > 0)
        two = (c[inside - 1] << np.uint64(21)) | c[inside]
        three = (two << np.uint64(21)) | c[inside + 1]
        shift = np.uint64(64 - bits)

        def number(values: np.ndarray, salt: int) -> np.ndarray:
            return ((hs.mix(values + np.uint64(salt)) >> shift)).astype(np.int64)

        letters = np.stack([number(two, 1 << 62), number(three, 0)])
        prefix = suffix = None
        affixes = []
        for k in range(4):
            first = np.where(self.start + k < self.end, c[np.minimum(self.start + k, len(c) - 1)], np.uint64(0))
            last = np.where(self.end - 1 - k >= self.start, c[self.end - 1 - k], np.uint64(0))
            prefix = first if prefix is None else hs.mix(prefix) + first
            suffix = last if suffix is None else hs.mix(suffix) + last
            if k:
                affixes += [number(prefix, 2 * k + 101), number(suffix, 2 * k + 102)]
        if len(self.start):
            weight = hs.mix(c) * hs._powers("step", hs._STEP, len(c))[:len(c)] * (c > 0)
            sums = np.add.reduceat(weight, self.start) * hs._powers("back", pow(hs._STEP, -1, 1 << 64), len(c))[self.start]
            affixes.append(number(sums, 7))
        else:
            affixes.append(np.zeros(0, np.int64))
        return letters, np.stack(affixes)


def _posteriors(emission: np.ndarray, transition: np.ndarray, length: np.ndarray, expected: bool = False):
    """Word posteriors of chains laid end to end; the chains' lengths sum to the rows.

    Forward-backward runs over the position in the chain, longest chains first, so each
    step is one matrix product for all chains that are that long. With ``expected``, also
    returns the expected number of each label pair.
    """
    order = np.argsort(-length, kind="stable")
    begin = (np.cumsum(length) - length)[order]
    size = length[order]
    e = np.exp(emission - emission.max(axis=1, keepdims=True)).astype(np.float64)
    t = np.exp(transition - transition.max())
    alpha = np.empty_like(e)
    most = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, most + 1), side="right")
    for k in range(most):
        at = begin[:active[k]] + k
        now = e[at] if k == 0 else (alpha[at - 1] @ t) * e[at]
        alpha[at] = now / now.sum(axis=1, keepdims=True)
    gamma = np.empty_like(e)
    pairs = np.zeros_like(t)
    beta = np.ones((len(size), e.shape[1]))
    for k in range(most - 1, -1, -1):
        n = active[k]
        at = begin[:n] + k
        now = alpha[at] * beta[:n]
        gamma[at] = now / now.sum(axis=1, keepdims=True)
        if k:
            ahead = e[at] * beta[:n]
            if expected:
                joint = alpha[at - 1][:, :, None] * t[None] * ahead[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back = ahead @ t.T
            beta[:n] = back / back.sum(axis=1, keepdims=True)
    return (gamma, pairs) if expected else gamma


class Model:
    """Labels, emission weights per feature, transition weights."""

    def __init__(self, labels: list[str], bits: int = TABLE_BITS):
        self.labels, self.bits = labels, bits
        self.weights = np.zeros((1 << bits, len(labels)), np.float32)
        self.transition = np.zeros((len(labels), len(labels)))

    def emissions(self, words: Words) -> np.ndarray:
        if not len(words.start):
            return np.zeros((0, len(self.labels)), np.float32)
        letters, affixes = words.features(self.bits)
        total = self.weights[affixes[0]]
        for row in affixes[1:]:
            total = total + self.weights[row]
        # Letters of a word stand together: their first index follows from the lengths.
        first = np.cumsum(words.end - words.start) - (words.end - words.start)
        by_letter = self.weights[letters[0]]
        by_letter += self.weights[letters[1]]
        return total + np.add.reduceat(by_letter, first, axis=0)

    def label(self, text: str) -> tuple[Words, np.ndarray]:
        """The words of a text and their posteriors."""
        words = Words(text)
        _, length = np.unique(words.line, return_counts=True)
        return words, _posteriors(self.emissions(words), self.transition, length)


def fit(texts: list[tuple[str, str]], rounds: int = ROUNDS, bits: int = TABLE_BITS) -> Model:
    """A model from (text, label) pairs, by gradient steps on the penalised log-likelihood."""
    labels = sorted({label for _, label in texts})
    model = Model(labels, bits)
    if len(labels) < 2:
        return model
    runs = []
    for text, label in texts:
        kept = text.split()
        step = max(1, len(kept) // TRAIN_WORDS)
        # Runs of neighbouring words from all over the text.
        for at in range(0, len(kept) - RUN + 1 if len(kept) >= RUN else 1, RUN * step):
            runs.append((" ".join(kept[at:at + RUN]), labels.index(label)))
    chance = np.random.default_rng(4)
    chance.shuffle(runs)
    words = Words("\n".join(text for text, _ in runs))
    gold = np.array([label for _, label in runs])[words.line]
    letters, affixes = words.features(bits)
    counts = words.end - words.start
    word_of = np.concatenate([np.repeat(np.arange(len(counts)), counts)] * 2 + [np.arange(len(counts))] * len(affixes))
    ids = np.concatenate([letters.ravel(), affixes.ravel()])
    used, ids = np.unique(ids, return_inverse=True)
    order = np.argsort(word_of, kind="stable")
    word_of, ids = word_of[order], ids[order]
    first = np.searchsorted(word_of, np.arange(len(counts)))
    # Neighbouring runs, of whatever languages the shuffle gave, make one chain.
    length = np.full(len(counts) // SEQUENCE + 1, SEQUENCE)
    length[-1] = len(counts) - SEQUENCE * (len(length) - 1)
    length = length[length > 0]
    inner = np.ones(len(counts), bool)
    inner[np.cumsum(length) - length] = False
    seen = np.zeros_like(model.transition)
    np.add.at(seen, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
    k = len(labels)
    w, t = np.zeros((len(used), k)), np.zeros((k, k))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    target = np.eye(k)[gold]
    for n in range(1, rounds + 1):
        gamma, pairs = _posteriors(np.add.reduceat(w[ids], first, axis=0), t, length, expected=True)
        error = (target - gamma)[word_of]
        grad = np.stack([np.bincount(ids, error[:, j], len(used)) for j in range(k)], axis=1) / len(counts) - PENALTY * w
        both = ((w, grad, 0), (t, (seen - pairs) / len(counts) - PENALTY * t, 2))
        for value, g, at in both:
            state[at] = 0.9 * state[at] + 0.1 * g
            state[at + 1] = 0.99 * state[at + 1] + 0.01 * g * g
            value += 0.1 * (state[at] / (1 - 0.9 ** n)) / (np.sqrt(state[at + 1] / (1 - 0.99 ** n)) + 1e-8)
    model.weights[used] = w
    model.transition = t
    return model


def train(docs: DataFrame, texts_per_label: int = TRAIN_TEXTS, most_chars: int = TRAIN_CHARS) -> Model | None:
    """Fit on at most about ``texts_per_label`` labelled texts of each label, drawn by hash.

    Only documents with a label and an id outside the held-out quarter (crc32 of the id
    modulo 4 is 2) are drawn; longer texts than ``most_chars`` are not. None without any.
    """
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.col("lang").cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & in_training(F.col("doc_id")) & (F.length("text") <= most_chars))
    counts = known.groupBy("lang").count().collect()  # one row per label
    if not counts:
        return None
    limit = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], int((1 << 30) * min(1.0, texts_per_label / r["count"])))])
    rows = known.filter(draw < limit[F.col("lang")]).select("text", "lang", draw.alias("draw"), "doc_id").collect()
    return fit([(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["draw"], r["doc_id"], r["text"]))])


def _pieces(text: str):
    """A text in pieces cut at line ends, which chains never cross."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= PIECE_CHARS else text.find("\n", at + PIECE_CHARS)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def predict(texts: list[str | None], model: Model | None) -> tuple[list[str], list[float], list[float]]:
    """(label, score, certainty) of each text; certainty is the mean of its words' largest posteriors."""
    labels, scores, certain = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    if model is None:
        return labels, scores, certain
    largest = np.zeros(len(texts))
    sums, counts, letters = np.zeros((len(texts), len(model.labels))), np.zeros(len(texts)), np.zeros(len(texts), bool)

    def add(rows: list[int], parts: list[str]) -> None:
        # Texts are joined by a line end, so that no chain runs over two of them.
        words, gamma = model.label("\n".join(parts))
        bounds = np.cumsum([0] + [len(x) + 1 for x in parts]) + 4
        at = np.searchsorted(words.start, bounds)
        total = np.concatenate([np.zeros((1, gamma.shape[1])), np.cumsum(gamma, axis=0)])
        np.add.at(sums, rows, total[at[1:]] - total[at[:-1]])
        np.add.at(counts, rows, at[1:] - at[:-1])
        total = np.concatenate([np.zeros(1), np.cumsum(gamma.max(axis=1))]) if len(gamma) else np.zeros(1)
        np.add.at(largest, rows, total[at[1:]] - total[at[:-1]])
        if words.letters:
            for row, part in zip(rows, parts, strict=True):
                letters[row] |= any(map(str.isalpha, part))

    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in _pieces(text or ""):
            rows.append(i)
            parts.append(piece)
            size += len(piece)
            if size >= PIECE_CHARS:
                add(rows, parts)
                rows, parts, size = [], [], 0
    if rows:
        add(rows, parts)
    for i in np.flatnonzero(letters & (counts > 0)):
        mean = sums[i] / counts[i]
        best = int(mean.argmax())
        labels[i], scores[i] = model.labels[best], float(min(1.0, max(0.0, mean[best])))
        certain[i] = float(min(1.0, max(0.0, largest[i] / counts[i])))
    return labels, scores, certain


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of each document, from its text alone.

    Null texts, texts without a letter, and all texts where there was nothing to learn
    from (model None) get ``und`` and 0. A tie goes to the label first in order. Repeated
    rows and rows with a null id are answered like any other; other columns are ignored.
    """

    def task(batches):
        for batch in batches:
            labels, scores, _ = predict(batch.column(1).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lean(task), "doc_id long, lang_pred string, score double")


def identified_only(docs: DataFrame, model: Model | None, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents with a language, in all their columns: not ``und``, words certain to ``min_score`` or more.

    Certainty is judged per word, as the mean of each word's largest posterior: a text in
    several languages stays if its words are told apart, however its score is spread.
    """
    column = docs.columns.index("text")

    def task(batches):
        for batch in batches:
            labels, _, certain = predict(batch.column(column).to_pylist(), model)
            yield batch.filter(pa.array([x != UNKNOWN and c >= min_score for x, c in zip(labels, certain, strict=True)], pa.bool_()))

    return docs.mapInArrow(lean(task), docs.schema)


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, end, lang, score): the runs of words of one language in each text.

    ``start`` and ``end`` count code points; ``score`` is the mean posterior of the run.
    """

    def task(batches):
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                before = 0
                for piece in _pieces(text or ""):
                    words, gamma = model.label(piece)
                    if len(gamma):
                        best = gamma.argmax(axis=1)
                        cut = np.flatnonzero(np.diff(best)) + 1
                        for a, b in zip([0, *cut], [*cut, len(best)], strict=True):
                            out.append((doc, before + int(words.start[a]) - 4, before + int(words.end[b - 1]) - 4,
                                        model.labels[best[a]], float(gamma[a:b, best[a]].mean())))
                    before += len(piece)
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("doc_id", "start", "end", "lang", "score"), x, strict=True)) for x in out],
                schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("score", pa.float64())]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lean(task), "doc_id long, start long, end long, lang string, score double")
