"""License notices by conditional compression, confirmed word by word.

Where the decisive words (name, version) of a template stand, a block of the template's
size around them is compressed alone and with the template as a raw dictionary. Templates
are ranked by the bytes they save, over all blocks of a text, and in that order confirmed
by their wording: a winner has enough of its words there in order, all its decisive words,
and no word more that names another license or denies it. Its words are taken out, the
templates that reach into them are compressed and ranked again, and so on until none is
confirmed. The differing words are reported exactly.

Lines with a word that licenses use, and their neighbours, form candidate blocks. Of one
that touches no confirmed place the template that saves most is reported as the nearest.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    license: str
    name: str
    decisive: tuple[str, ...]
    text: str


# The wording of well-known licenses and notices.
TEMPLATES = (
    Template("MIT", "notice", ("mit",), "Released under the MIT License."),
    Template("MIT", "permission", ("free", "charge", "sublicense"), (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software.")),
    Template("Apache-2.0", "notice", ("apache", "2"), "Licensed under the Apache License, Version 2.0."),
    Template("Apache-2.0", "header", ("apache", "2", "compliance"), (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.")),
    Template("GPL-3.0", "notice", ("gnu", "general", "public", "3"), "This work is licensed under the GNU General Public License, version 3."),
    Template("GPL-3.0", "header", ("gnu", "general", "public", "3"), (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")),
    Template("GPL-2.0", "notice", ("gnu", "general", "public", "2"), "This work is licensed under the GNU General Public License, version 2."),
    Template("BSD-3-Clause", "conditions", ("redistribution", "neither", "endorse"), (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of "
        "the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.")),
    Template("ISC", "permission", ("purpose", "without", "fee"), (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.")),
    Template("CC-BY-NC-4.0", "notice", ("cc", "by-nc", "4"), "Licensed under CC BY-NC 4.0."),
    Template("CC-BY-NC-4.0", "sentence", ("creative", "commons", "attribution-noncommercial", "4"), (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.")),
    Template("CC-BY-4.0", "notice", ("cc", "by", "4"), "Licensed under CC BY 4.0."),
    Template("CC-BY-4.0", "sentence", ("creative", "commons", "attribution", "4"), (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.")),
    Template("AGPL-3.0", "notice", ("gnu", "affero", "public", "3"), "This work is licensed under the GNU Affero General Public License, version 3."),
    Template("AGPL-3.0", "header", ("gnu", "affero", "public", "3"), (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")),
    Template("LGPL-3.0", "notice", ("gnu", "lesser", "public", "3"), "This work is licensed under the GNU Lesser General Public License, version 3."),
    Template("LGPL-3.0", "header", ("gnu", "lesser", "public", "3"), (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")),
    Template("LGPL-2.1", "header", ("gnu", "lesser", "public", "2.1"), (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.")),
    Template("GPL-2.0", "header", ("gnu", "general", "public", "2"), (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.")),
    Template("MPL-2.0", "header", ("mozilla", "public", "2"), (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.")),
    Template("BSD-2-Clause", "conditions", ("redistribution", "binary", "disclaimer"), (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution.")),
    Template("CC0-1.0", "waiver", ("extent", "waived", "neighboring"), (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.")),
    Template("CC-BY-SA-4.0", "notice", ("cc", "by-sa", "4"), "Licensed under CC BY-SA 4.0."),
    Template("CC-BY-SA-4.0", "sentence", ("creative", "commons", "attribution-sharealike", "4"), (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.")),
    Template("Unlicense", "dedication", ("unencumbered", "domain"), (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means.")),
)

#: Words that make another license of a notice, or none, where the template lacks them.
REFUSED = frozenset({"affero", "lesser", "library", "noncommercial", "non-commercial", "not", "never"})
#: Of these the word before a notice counts too.
DENIALS = frozenset({"not", "never"})

#: Words that every template has one of.
CUES = r"(?i)licen[cs]|copyright|permission|warrant|redistribut|unencumbered"
_CUE = re.compile(CUES)
_WORD = re.compile(r"[^\s\"'(),;:]*[^\s\"'(),;:.]")
_WHOLE = re.compile(r"[0-9]+\.0")
#: Lines between cues of one block; characters kept of a line around a cue.
GAP_LINES, LINE_REACH = 3, 1000
MIN_SIMILARITY = 0.8
#: Words looked at on each side of a template's expected place, besides as many as it has.
SLACK = 8


def _plain(word: str) -> str:
    """Lower case; a version 3.0 is a version 3."""
    word = word.lower()
    return word[:-2] if _WHOLE.fullmatch(word) else word


def words(text: str) -> list[str]:
    return [_plain(w) for w in _WORD.findall(text)]


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the candidate blocks of a text, in order and apart."""
    spans: list[list[int]] = []
    for found in _CUE.finditer(text):
        start, end = found.start(), found.end()
        for _ in range(2):  # the line itself and the one before
            low = text.rfind("\n", max(0, found.start() - LINE_REACH), start)
            start = low if low >= 0 else max(0, found.start() - LINE_REACH)
        for _ in range(GAP_LINES):
            high = text.find("\n", end, found.end() + LINE_REACH)
            end = min(len(text), high + 1 if high >= 0 else found.end() + LINE_REACH)
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(end, spans[-1][1])
        else:
            spans.append([start, end])
    for start, end in spans:
        yield start, end


def compare(template: list[str], block: list[str | None]) -> tuple[float, list[str], dict[int, int]]:
    """(similarity, differences, place in the block of each matched template word).

    The similarity is the share of words found in order among the template's words and those
    that the block has more between them, marks of comments and lists not counted. None
    stands for a word that another template has taken."""
    matched = [m for m in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    if not matched:
        return 0.0, [], {}
    differences, i, j = [], 0, matched[0].b
    for m in matched:
        for sign, part in (("-", template[i:m.a]), ("+", block[j:m.b])):
            differences += [sign + w for w in part if w is not None]
        i, j = m.a + m.size, m.b + m.size
    differences += ["-" + w for w in template[i:]]
    places = {m.a + k: m.b + k for m in matched for k in range(m.size)}
    more = sum(d[0] == "+" and any(c.isalnum() for c in d) for d in differences)
    return len(places) / (len(template) + more), differences, places


class Scanner:
    """The templates as compressors; made in each task."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES):
        self.templates = templates
        self.words = [words(t.text) for t in templates]
        options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.plain = zstandard.ZstdCompressor(level=3, **options)
        self.with_template = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(
            t.text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **options) for t in templates]

    def ranked(self, block: str) -> list[tuple[int, int]]:
        """(bytes saved, template), most first; ties by template order."""
        data = block.encode("utf-8", "surrogatepass")
        size = len(self.plain.compress(data))
        return sorted(((size - len(c.compress(data)), k) for k, c in enumerate(self.with_template)), key=lambda x: (-x[0], x[1]))

    def saved(self, block: str, k: int) -> int:
        """Bytes that the template saves on a block."""
        data = block.encode("utf-8", "surrogatepass")
        return len(self.plain.compress(data)) - len(self.with_template[k].compress(data))

    def confirmed(self, text: str) -> list[tuple]:
        """(start, end, template, bytes saved, similarity, differences) of each confirmed template, in order and apart."""
        low = text.lower()
        possible = [k for k, t in enumerate(self.templates) if all(w in low for w in t.decisive)]
        if not possible:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        tokens: list[str | None] = [_plain(text[a:b]) for a, b in spans]
        wanted = {w for k in possible for w in self.templates[k].decisive}
        at = defaultdict(list)
        for p, w in enumerate(tokens):
            if w in wanted:
                at[w].append(p)
        heap: list[tuple] = []
        #: Ranked templates whose wording was not confirmed, by the place of their decisive word.
        refused = defaultdict(set)
        widest = 3 * max(len(self.words[k]) for k in possible) + SLACK

        def rank(k: int, p: int) -> None:
            """Compress the block of the template around the word at p and queue it by its saving."""
            own = self.words[k]
            places = [i for i, w in enumerate(own) if w == tokens[p]]
            reach = len(own) + SLACK
            first, last = max(0, p - places[-1] - reach), min(len(tokens), p - places[0] + len(own) + reach)
            if not set(self.templates[k].decisive) <= set(tokens[first:last]):
                return
            left = " ".join(text[slice(*spans[j])] for j in range(first, last) if tokens[j] is not None)
            heapq.heappush(heap, (-self.saved(left, k), k, p, first, last, tokens[first:last]))

        def wording(k: int, first: int, window: list[str | None]):
            """(taken places, similarity, differences) if the block holds the template."""
            own = self.words[k]
            similarity, differences, found = compare(own, window)
            if similarity < MIN_SIMILARITY or not all(any(own[i] == w for i in found) for w in self.templates[k].decisive):
                return None
            taken = sorted(first + j for j in found.values())
            extra = {d[1:] for d in differences if d[0] == "+"} & REFUSED
            if extra or (taken[0] and tokens[taken[0] - 1] in DENIALS):
                return None
            return taken, similarity, differences

        for k in possible:
            for p in at[min(self.templates[k].decisive, key=lambda w: len(at[w]))]:
                rank(k, p)
        rows = []
        while heap:
            less, k, p, first, last, seen = heapq.heappop(heap)
            window = tokens[first:last]
            if tokens[p] is None:
                continue
            if window != seen:  # a winner has taken words of the block: rank again
                rank(k, p)
                continue
            held = wording(k, first, window)
            if held is None:
                refused[p].add(k)
                continue
            taken, similarity, differences = held
            for j in taken:
                tokens[j] = None
            end = spans[taken[-1]][1]
            while end < len(text) and not text[end].isspace():
                end += 1
            rows.append((spans[taken[0]][0], end, k, -less, similarity, differences))
            for q in range(max(0, taken[0] - widest), min(len(tokens), taken[-1] + widest)):
                for other in refused.pop(q, ()):
                    if tokens[q] is not None:
                        rank(other, q)
        return sorted(rows, key=lambda x: x[:3])

    def scan(self, text: str) -> Iterator[tuple]:
        """(start, end, license, template, saved, similarity, differences) per confirmed template, or block without one (license None)."""
        rows = []
        places = self.confirmed(text)
        for start, end, k, saved, similarity, differences in places:
            rows.append((start, end, self.templates[k].license, self.templates[k].name, saved, similarity, differences))
        for start, end in blocks(text):
            if not any(a < end and start < b for a, b, *_ in places):
                saved, k = self.ranked(text[start:end])[0]
                similarity, differences, _ = compare(self.words[k], words(text[start:end]))
                rows.append((start, end, None, None, saved, similarity, differences))
        yield from sorted(rows, key=lambda x: x[:2])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per confirmed template, and per candidate block without one.

    Columns: doc_id, start, end (code points), license, template, saved_bytes, similarity,
    differences. ``license`` is null where no template was confirmed; ``differences`` lists the
    words the template lacks ("+") or has in excess ("-"). An empty table gives no row. Whole texts are searched; null,
    empty and cue-less texts give no row. Repeated rows and null ids are answered like
    any other; other columns are ignored.
    """
    names = ["doc_id", "start", "end", "license", "template", "saved_bytes", "similarity", "differences"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.list_(pa.string())]

    def task(batches):
        scanner = Scanner()
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.match_substring_regex(batch.column(1), CUES), False))
            rows = [(doc, *row) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                    for row in scanner.scan(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        task, "doc_id long, start long, end long, license string, template string, saved_bytes long, similarity double, differences array<string>")
