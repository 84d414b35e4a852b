"""Exact removal of long byte strings that smaller documents already hold.

A byte goes if a string of ``length`` bytes that covers it also starts in a document
with a smaller id. Every such string (a window) has an anchor: the ``GRAM``-byte gram in
it with the least hash, leftmost of equals. Equal windows have equal anchors at equal
offsets, so windows need to be compared within an anchor only. The windows of a text
with one anchor occurrence follow each other; the stretch they cover is a unit.

1. Documents are packed into compressed batches of a few MB, written once. Each batch
   sends its distinct units as (anchor, unit hash, least document), packed per bucket of
   anchors. A bucket finds each unit's least document: every occurrence in a larger one
   is a match as a whole. That deals with the inner part of all repeats.
2. What remains are anchors with several different units, where repeats begin or end.
   Their units (each once, with its least document) are read from the batches and
   gathered by anchor into run-length indexes (``RunIndex``), through which the units
   are streamed to find the windows that smaller documents hold.
3. Anchors with too many units for an index (very common phrases) take an exact way that
   splits: their single windows are grouped by hash, with partial minima.
4. Each batch applies its answers, in one task that holds one batch.

A lost executor costs only the tasks it ran: batches and answers are written tables.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import hashing as hs
from corpusmill.llm.run_index import RunIndex
from corpusmill.llm.tables import discard, lean, lean_group, written

LENGTH = 50
GRAM = 20
BATCH_BYTES = 2 << 20
BUCKET_UNITS = 400_000  # units of a bucket, on average
INDEX_BYTES = 1 << 20  # bytes of a run-length index, on average
#: Anchors with more different units than this, in a batch or in all, are split by window.
BATCH_FORMS, ALL_FORMS = 8, 64
#: Windows of a piece of text, small enough to stay in the processor's cache, and bits to count them.
_PIECE, _BITS = 1 << 17, 18


def units(data: np.ndarray, offsets: np.ndarray, known: np.ndarray, length: int):
    """(first window, last window, anchor, hash, anchor place, row) of the units of the texts.

    A text longer than a piece is cut into pieces that overlap by length - 1 bytes.
    """
    parts = []
    gram = min(GRAM, length)
    values, low = hs.byte_values(), np.uint64((1 << _BITS) - 1)
    step = hs._powers("step", hs._STEP, _PIECE + length)
    back = hs._powers("back", pow(hs._STEP, -1, 1 << 64), _PIECE + length)
    ends = offsets[1:]
    for lo in range(0, max(0, len(data) - length + 1), _PIECE):
        piece = data[lo:lo + _PIECE + length - 1]
        n = len(piece) - length + 1
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(values[piece] * step[:len(piece)], out=sums[1:])
        grams = (sums[gram:] - sums[:-gram]) * back[:len(piece) - gram + 1]
        grams ^= grams >> np.uint64(32)
        grams *= np.uint64(0xD6E8FEB86659FD93)
        least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        width, want = 1, length - gram + 1
        while width < want:
            shift = min(width, want - width)
            least = np.minimum(least[:-shift], least[shift:])
            width += shift
        place = (least & low).astype(np.int32)
        # Windows that run over the end of a text, or of a text without an id, are none.
        good = np.ones(n, bool)
        for row in range(int(np.searchsorted(ends, lo, side="right")), len(ends)):
            if ends[row] - length + 1 >= lo + n:
                break
            good[max(0, ends[row] - length + 1 - lo):max(0, ends[row] - lo)] = False
        for row in np.flatnonzero(~known):
            good[max(0, offsets[row] - lo):max(0, ends[row] - lo)] = False
        changed = place[1:] != place[:-1]
        new, last = good.copy(), good.copy()
        new[1:] &= ~good[:-1] | changed
        last[:-1] &= ~good[1:] | changed
        a, b = np.flatnonzero(new), np.flatnonzero(last)
        place = place[a].astype(np.int64)
        whole = hs.mix(hs.mix((sums[b + length] - sums[a]) * back[a]) + (b - a).astype(np.uint64))
        parts.append((a + lo, b + lo, grams[place], whole, place + lo))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64), none, none
    a, b, anchor, whole, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    return a, b, anchor, whole, place, np.searchsorted(offsets, a, side="right") - 1


class Batch:
    """A packed batch with its units and its distinct units (entries), in a fixed order."""

    def __init__(self, payload: bytes, length: int, buckets: int):
        self.table = pa.ipc.open_stream(payload).read_all()
        ids = self.table["doc_id"].combine_chunks()
        self.data, self.offsets = hs.text_bytes(self.table["text"])
        known = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False), bool)
        self.a, self.b, self.anchor, self.whole, self.place, self.row = units(self.data, self.offsets, known, length)
        self.doc = ids.cast(pa.int64()).fill_null(0).to_numpy()[self.row]
        # Units with one hash have one anchor: sorting by the hash alone brings them together.
        order = np.argsort(self.whole)
        new = np.ones(len(order), bool)
        new[1:] = self.whole[order[1:]] != self.whole[order[:-1]]
        self.entry = np.empty(len(order), np.int64)  # of each unit
        self.entry[order] = number = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        self.least = np.minimum.reduceat(self.doc[order], start) if len(start) else self.doc[:0]
        self.at = np.full(len(start), len(order), np.int64)  # the first unit of each entry in its least document
        lowest = self.doc[order] == self.least[number]
        np.minimum.at(self.at, number[lowest], order[lowest])
        anchor = self.anchor[self.at]
        by_anchor = np.argsort(anchor, kind="stable")
        first = np.ones(len(anchor), bool)
        first[1:] = anchor[by_anchor[1:]] != anchor[by_anchor[:-1]]
        forms = np.diff(np.append(np.flatnonzero(first), len(anchor)))
        self.common = np.zeros(len(anchor), bool)
        self.common[by_anchor] = np.repeat(forms > BATCH_FORMS, forms)
        self.common_first = by_anchor[first][forms > BATCH_FORMS]
        self.bucket = (anchor >> np.uint64(32)) % np.uint64(buckets)

    def sent(self) -> dict[int, np.ndarray]:
        """Entries that each bucket is told of: a common anchor sends only its first."""
        tell = ~self.common
        tell[self.common_first] = True
        index = np.flatnonzero(tell)
        order = np.argsort(self.bucket[index], kind="stable")
        index = index[order]
        return {int(v): x for v, x in zip(*_sections(self.bucket[index], index), strict=True)}


def _planes(values: np.ndarray) -> bytes:
    """Bytes of an array, all first bytes before all second ones: compresses better."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _from_planes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, len(data) // width).T).view(kind).ravel()


def _packed(docs: DataFrame) -> DataFrame:
    column = docs.columns.index("text")

    def pack(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = hs.text_bytes(batch.column(column))
            for row, end in hs.row_blocks(offsets, BATCH_BYTES):
                sink = pa.BufferOutputStream()
                part = pa.Table.from_batches([batch.slice(row, end - row)])
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(part)
                yield pa.RecordBatch.from_arrays([
                    pa.array([number], pa.int64()), pa.array([int(offsets[end] - offsets[row])], pa.int64()),
                    pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch", "size", "payload"])
                number += 1

    return docs.mapInArrow(lean(pack, None), "batch long, size long, payload binary")


def _told(packed: DataFrame, length: int, buckets: int) -> DataFrame:
    def tell(batches):
        for record in batches:
            for number, payload in zip(record.column(0).to_pylist(), record.column(1), strict=True):
                own = Batch(payload.as_py(), length, buckets)
                rows = {"bucket": [], "batch": [], "base": [], "body": []}
                for bucket, index in own.sent().items():
                    base = int(own.least[index].min())
                    delta = (own.least[index] - base).astype(np.uint64)
                    wide = np.uint32 if not len(delta) or int(delta.max()) < 1 << 32 else np.uint64
                    whole = np.where(own.common[index], np.uint64(0), own.whole[own.at[index]])
                    anchor = own.anchor[own.at[index]].astype(np.uint32)
                    rows["bucket"].append(bucket)
                    rows["batch"].append(number)
                    rows["base"].append(base)
                    rows["body"].append([_planes(anchor), _planes(whole), _planes(delta.astype(wide))])
                yield pa.RecordBatch.from_arrays([
                    pa.array(rows["bucket"], pa.int32()), pa.array(rows["batch"], pa.int64()),
                    pa.array(rows["base"], pa.int64()), pa.array(rows["body"], pa.list_(pa.binary()))],
                    names=["bucket", "batch", "base", "body"])

    return packed.select("batch", "payload").mapInArrow(lean(tell, None), "bucket int, batch long, base long, body array<binary>")


def _answered(table: pa.Table) -> pa.Table:
    """For one bucket: which sent entries a smaller document holds, and which to ask for."""
    source, anchors, wholes, docs, ordinal = [], [], [], [], []
    batches = table["batch"].to_pylist()
    for k, (base, body) in enumerate(zip(table["base"].to_pylist(), table["body"].to_pylist(), strict=True)):
        anchors.append(_from_planes(body[0], np.uint32))
        wholes.append(_from_planes(body[1], np.uint64))
        n = len(anchors[-1])
        docs.append(_from_planes(body[2], np.uint32 if len(body[2]) == 4 * n else np.uint64).astype(np.int64) + base)
        source.append(np.full(n, k, np.int32))
        ordinal.append(np.arange(n, dtype=np.uint32))
    anchor, whole, doc, source, ordinal = (np.concatenate(x) for x in (anchors, wholes, docs, source, ordinal))
    order = np.lexsort((doc, whole, anchor))
    anchor, whole, doc, source, ordinal = (x[order] for x in (anchor, whole, doc, source, ordinal))
    n = len(anchor)
    other = np.ones(n, bool)
    other[1:] = anchor[1:] != anchor[:-1]
    new = other.copy()
    new[1:] |= whole[1:] != whole[:-1]
    least = np.repeat(doc[new], np.diff(np.append(np.flatnonzero(new), n)))
    group = np.cumsum(other) - 1
    forms = np.bincount(group, new)
    # Hash 0 stands for a common anchor of some batch; everything with that anchor is split.
    split = (np.bincount(group, whole == 0) > 0) | (forms > ALL_FORMS)
    full = (doc > least) & (whole != 0)
    ask = ~full & (whole != 0) & (forms > 1)[group] & ~split[group]
    windows = ~full & (whole != 0) & split[group]
    rows = {"batch": [], "full": [], "ask": [], "windows": []}
    by_source = np.argsort(source, kind="stable")
    cuts = np.searchsorted(source[by_source], np.arange(len(batches) + 1))
    for k, batch in enumerate(batches):
        own = by_source[cuts[k]:cuts[k + 1]]
        rows["batch"].append(batch)
        for name, mask in (("full", full), ("ask", ask), ("windows", windows)):
            rows[name].append(_planes(np.sort(ordinal[own[mask[own]]])))
    return pa.table({"bucket": pa.array([table["bucket"][0].as_py()] * len(batches), pa.int32()),
                     "batch": pa.array(rows["batch"], pa.int64()),
                     **{name: pa.array(rows[name], pa.binary()) for name in ("full", "ask", "windows")}})


_ANSWER = "bucket int, batch long, full binary, ask binary, windows binary"
_CONTEXT = "group long, batch long, entries binary, docs binary, sizes binary, places_of binary, body binary, hashes array<long>, owners array<long>, places array<long>"


def _contexts(length: int, buckets: int, groups: int):
    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = {x.split(" ")[0]: [] for x in _CONTEXT.split(", ")}
        for number, payload in zip(left["batch"].to_pylist(), left["payload"], strict=True):
            own = Batch(payload.as_py(), length, buckets)
            sent = own.sent()
            ask, split = [np.zeros(0, np.int64)], [np.flatnonzero(own.common)]
            for answer in right.to_pylist():
                index = sent[answer["bucket"]]
                ask.append(index[_from_planes(answer["ask"], np.uint32)])
                split.append(index[_from_planes(answer["windows"], np.uint32)])
            ask, split = np.concatenate(ask), np.concatenate(split)
            group = own.anchor[own.at[ask]] % np.uint64(groups)
            order = np.argsort(group, kind="stable")
            ask, group = ask[order], group[order]
            for value, entries in zip(*_sections(group, ask), strict=True):
                at = own.at[entries]
                rows["group"].append(int(value))
                rows["batch"].append(number)
                rows["entries"].append(entries.astype(np.uint32).tobytes())
                rows["docs"].append(own.least[entries].astype(np.int64).tobytes())
                rows["sizes"].append((own.b[at] + length - own.a[at]).astype(np.uint32).tobytes())
                rows["places_of"].append((own.place[at] - own.a[at]).astype(np.uint8).tobytes())
                rows["body"].append(b"".join(own.data[i:j + length].tobytes() for i, j in zip(own.a[at], own.b[at], strict=True)))
                for name in ("hashes", "owners", "places"):
                    rows[name].append(None)
            if len(split):
                at = own.at[split]
                count = own.b[at] - own.a[at] + 1
                start = np.repeat(own.a[at], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                rows["group"].append(None)
                rows["batch"].append(number)
                for name in ("entries", "docs", "sizes", "places_of", "body"):
                    rows[name].append(None)
                rows["hashes"].append(_window_hashes(own.data, start, length).view(np.int64))
                rows["owners"].append(np.repeat(own.least[split], count).astype(np.int64))
                rows["places"].append((np.repeat(split, count) << 8 | (start - np.repeat(own.a[at], count))).astype(np.int64))
        kinds = {"group": pa.int64(), "batch": pa.int64(), "hashes": pa.list_(pa.int64()), "owners": pa.list_(pa.int64()), "places": pa.list_(pa.int64())}
        return pa.table({name: pa.array(x, kinds.get(name, pa.binary())) for name, x in rows.items()})

    return read


def _sections(keys: np.ndarray, values: np.ndarray):
    """(distinct keys, their values) of arrays sorted by key."""
    if not len(keys):
        return [], []
    found, start = np.unique(keys, return_index=True)
    return found, np.split(values, start[1:])


def _window_hashes(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    values, total = hs.byte_values(), np.zeros(len(start), np.uint64)
    for j in range(length):
        total = total * np.uint64(hs._STEP) + values[data[start + j]]
    return hs.mix(total)


def _indexed(length: int):
    """The windows of each unit of a group that smaller documents hold, as bit masks."""

    def search(table: pa.Table) -> pa.Table:
        body = np.frombuffer(b"".join(table["body"].to_pylist()), np.uint8)
        sizes, docs, places = (np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()]).astype(np.int64)
                               for name, kind in (("sizes", np.uint32), ("docs", np.int64), ("places_of", np.uint8)))
        ends = np.cumsum(sizes)
        masks = np.zeros(len(sizes), np.uint64)
        near = np.flatnonzero(_extended(body, ends - sizes, ends, places, docs, length))
        if len(near):
            strings = [body[i:j] for i, j in zip(ends[near] - sizes[near], ends[near], strict=True)]
            bits = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
            marks = RunIndex(strings, docs[near], length).marks(docs[near], length)
            masks[near] = [bits[:len(m)][m].sum() for m in marks]
        bounds = np.cumsum([0] + [len(x) // 4 for x in table["entries"].to_pylist()])
        return pa.table({"batch": table["batch"], "one": table["entries"],
                         "two": pa.array([masks[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())})

    return search


def _extended(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """Units that may share a window with another document's unit.

    A window reaches at least half of the bytes it has besides its anchor to one side of
    it, so a shared one shares the anchor with that many bytes on its left or its right.
    """
    gram = min(GRAM, length)
    half = (length - gram + 1) // 2
    anchor = starts + places
    out = np.zeros(len(starts), bool)
    for begin in (anchor - half, anchor):
        own = np.flatnonzero((begin >= starts) & (begin + gram + half <= ends))
        keys = _window_hashes(body, begin[own], gram + half)
        order = np.argsort(keys, kind="stable")
        keys, doc = keys[order], docs[own][order]
        if not len(keys):
            continue
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        several = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
        out[own[order[np.repeat(several, np.diff(np.append(first, len(keys))))]]] = True
    return out


class Repeats:
    """The repeats of a table of documents: packed batches and the answers to them."""

    def __init__(self, docs: DataFrame, length: int = LENGTH):
        self.docs, self.length = docs, length
        self.packed = written(_packed(docs), "repeats-batches")
        total = self.packed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        self.buckets = max(64, -(-total // (16 * BUCKET_UNITS)))
        answers = written(_told(self.packed, length, self.buckets).groupBy("bucket").applyInArrow(lean_group(_answered), _ANSWER), "repeats-answers")
        asked = answers.agg(F.coalesce(F.sum(F.octet_length("ask")), F.lit(0))).first()[0] // 4
        groups = max(128, -(-asked * (length + 16) // INDEX_BYTES))
        contexts = written(self.packed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
            lean_group(_contexts(length, self.buckets, groups)), _CONTEXT), "repeats-contexts")
        indexed = contexts.filter("group is not null").select("group", "batch", "entries", "docs", "sizes", "places_of", "body").groupBy(
            "group").applyInArrow(lean_group(_indexed(length)), "batch long, one binary, two binary")
        single = contexts.filter("group is null").select("batch", F.explode(F.arrays_zip("hashes", "owners", "places")).alias("w")).select(
            "batch", "w.hashes", "w.owners", "w.places")
        least = single.groupBy("hashes").agg(F.min("owners").alias("least"))
        held = single.join(least, "hashes").filter("least < owners").groupBy("batch").agg(F.collect_list("places").alias("places"))
        none = F.lit(None)
        self.answers = written(
            answers.select("batch", "bucket", F.col("full").alias("one"), none.cast("binary").alias("two"), none.cast("array<long>").alias("places"))
            .unionByName(indexed.select("batch", none.cast("int").alias("bucket"), "one", "two", none.cast("array<long>").alias("places")))
            .unionByName(held.select("batch", none.cast("int").alias("bucket"), none.cast("binary").alias("one"), none.cast("binary").alias("two"), "places")),
            "repeats-found")
        discard(answers, contexts)

    def _apply(self, make, schema) -> DataFrame:
        length, buckets = self.length, self.buckets

        def finish(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            for payload in left["payload"]:
                own = Batch(payload.as_py(), length, buckets)
                out.append(make(own, _removed(own, right, length)))
            return pa.concat_tables(out)

        return self.packed.groupBy("batch").cogroup(self.answers.groupBy("batch")).applyInArrow(lean_group(finish), schema)

    def digest(self) -> DataFrame:
        """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per document."""

        def make(own: Batch, gone: np.ndarray) -> pa.Table:
            total = np.concatenate([[0], np.cumsum(gone)])
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            inner = own.offsets[:-1][own.offsets[:-1] < len(gone)]
            first[inner] = gone[inner]
            spans = np.concatenate([[0], np.cumsum(first)])
            a, b = own.offsets[:-1], own.offsets[1:]
            kept = own.data[~gone]
            cut = own.offsets - total[own.offsets]
            hashes = [hashlib.sha256(kept[i:j].tobytes()).hexdigest() for i, j in zip(cut[:-1], cut[1:], strict=True)]
            return pa.table({"doc_id": own.table["doc_id"], "n_bytes": pa.array(b - a, pa.int64()),
                             "n_removed": pa.array(total[b] - total[a], pa.int64()),
                             "n_spans": pa.array(spans[b] - spans[a], pa.int64()), "kept_sha256": pa.array(hashes, pa.string())})

        return self._apply(make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

    def spans(self) -> DataFrame:
        """(doc_id, start, end) in bytes: the removed runs of each document."""

        def make(own: Batch, gone: np.ndarray) -> pa.Table:
            rows = [(i, int(a), int(b)) for i in range(len(own.offsets) - 1)
                    for a, b in _runs(gone[own.offsets[i]:own.offsets[i + 1]])]
            return pa.table({"doc_id": own.table["doc_id"].take(pa.array([x[0] for x in rows], pa.int64())),
                             "start": pa.array([x[1] for x in rows], pa.int64()), "end": pa.array([x[2] for x in rows], pa.int64())})

        return self._apply(make, "doc_id long, start long, end long")

    def cleaned(self) -> DataFrame:
        """The documents with their repeats cut out of the text; bytes of a character that
        was cut apart are dropped with it, and a null text stays null."""
        names = self.docs.columns

        def make(own: Batch, gone: np.ndarray) -> pa.Table:
            texts = own.table["text"].to_pylist()
            for i, text in enumerate(texts):
                part = gone[own.offsets[i]:own.offsets[i + 1]]
                if text is not None and part.any():
                    texts[i] = own.data[own.offsets[i]:own.offsets[i + 1]][~part].tobytes().decode("utf-8", "ignore")
            at = names.index("text")
            return own.table.set_column(at, own.table.schema.field(at), pa.array(texts, own.table.schema.field(at).type))

        return self._apply(make, self.docs.schema)


def _runs(mask: np.ndarray):
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return zip(edge[::2], edge[1::2], strict=True)


def _removed(own: Batch, answers: pa.Table, length: int) -> np.ndarray:
    """Which bytes of a batch go."""
    sent, held = own.sent(), np.zeros(len(own.least), bool)
    starts = []
    for answer in answers.to_pylist():
        if answer["bucket"] is not None:
            held[sent[answer["bucket"]][_from_planes(answer["one"], np.uint32)]] = True
        elif answer["one"] is not None:
            entries, masks = np.frombuffer(answer["one"], np.uint32).astype(np.int64), np.frombuffer(answer["two"], np.uint64)
            for k in range(int(masks.max()).bit_length() if len(masks) else 0):
                starts.append(entries[(masks >> np.uint64(k)) & np.uint64(1) > 0] << 8 | k)
        else:
            starts.append(np.array(answer["places"], np.int64))
    cover = np.zeros(len(own.data) + 1, np.int64)
    all_of = held[own.entry] | (own.doc > own.least[own.entry])
    np.add.at(cover, own.a[all_of], 1)
    np.add.at(cover, own.b[all_of] + length, -1)
    if starts:
        # Answers name an entry and a window; they hold for its units in the least document.
        found = np.unique(np.concatenate(starts))
        entry, k = found >> 8, found & 255
        mine = np.flatnonzero(~all_of)
        order = mine[np.argsort(own.entry[mine], kind="stable")]
        low, high = np.searchsorted(own.entry[order], entry), np.searchsorted(own.entry[order], entry, side="right")
        count = high - low
        unit = order[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        start = own.a[unit] + np.repeat(k, count)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + length, -1)
    return np.cumsum(cover[:-1]) > 0
