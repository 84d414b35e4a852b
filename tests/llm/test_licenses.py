from __future__ import annotations

import random

import pytest

from corpusmill.llm.licenses import TEMPLATES, Scanner, scan_licenses

PROSE = "Some words that have nothing to do with any of it and go on for a line or so.\n"


@pytest.mark.parametrize("template", TEMPLATES, ids=lambda t: f"{t.license}-{t.name}")
def test_each_template_is_found_in_prose(template):
    text = PROSE * 20 + template.text + "\n" + PROSE * 20
    found = [r for r in Scanner().scan(text) if r[2]]
    assert [r[2] for r in found] == [template.license]
    assert template.text in text[found[0][0]:found[0][1]] or len(template.text) > 300


@pytest.mark.parametrize("template", [t for t in TEMPLATES if len(t.text) > 150], ids=lambda t: f"{t.license}-{t.name}")
def test_rewrapped_and_slightly_edited(template):
    words = template.text.split()
    words.insert(4, "inserted")
    text = PROSE + "\n".join(" ".join(words[i:i + 9]) for i in range(0, len(words), 9)) + "\n" + PROSE
    rows = [r for r in Scanner().scan(text) if r[2]]
    assert [r[2] for r in rows] == [template.license] and rows[0][3] == template.name and "+inserted" in rows[0][6]


def test_a_wrong_version_is_not_confirmed():
    rows = list(Scanner().scan("This work is licensed under the GNU General Public License, version 9."))
    assert [r[2] for r in rows] == [None] and {"-3", "-2"} & set(rows[0][6])


@pytest.mark.parametrize("template", TEMPLATES, ids=lambda t: f"{t.license}-{t.name}")
def test_each_template_is_found_in_a_long_line(template):
    """Plain prose on both sides, without a line end: no rank of savings decides."""
    rng = random.Random(4)
    common = sorted({w for t in TEMPLATES if len(t.text) > 300 for w in t.text.split() if w.isalpha()} - {w for t in TEMPLATES for w in t.decisive})
    for _ in range(20):
        a, b = (" ".join(rng.choice(common) for _ in range(200)) for _ in range(2))
        assert template.license in {r[2] for r in Scanner().scan(f"{a} {template.text} {b}")}


GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as "
       "published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.")


@pytest.mark.parametrize("text,want", [
    (GNU.format("Affero ", 3), ["AGPL-3.0"]),
    (GNU.format("Lesser ", 3), ["LGPL-3.0"]),
    (GNU.format("Lesser ", "2.1"), ["LGPL-2.1"]),
    (GNU.format("", 2), ["GPL-2.0"]),
    (GNU.format("", "3.0"), ["GPL-3.0"]),
    (GNU.format("", 2) + "\n" + GNU.format("", 3), ["GPL-2.0", "GPL-3.0"]),
    ("This work is licensed under the GNU General Public License, version 3.0.", ["GPL-3.0"]),
    ("This work is licensed under the GNU Lesser General Public License, version 2.", []),
    ("This file is not Released under the MIT License.", []),
    ("This work is not licensed under the GNU General Public License, version 3.", []),
    ("Why not? No. Released under the MIT License.", ["MIT"]),
    ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]),
    ("Released by some of us here long ago under the terms that go with the MIT License.", []),
])
def test_words_that_change_the_license(text, want):
    assert [r[2] for r in Scanner().scan(text) if r[2]] == want


def test_the_saving_ranks_what_the_wording_confirms():
    """Both BSD templates hold word by word in the longer text; the one that saves more takes it."""
    longer = next(t for t in TEMPLATES if t.license == "BSD-3-Clause")
    shorter = next(t for t in TEMPLATES if t.license == "BSD-2-Clause")
    scanner = Scanner()
    row, = [r for r in scanner.scan(longer.text) if r[2]]
    assert row[2] == "BSD-3-Clause" and row[4] == scanner.saved(longer.text.replace(",", "").replace(":", "").replace(".", ""), TEMPLATES.index(longer))
    assert row[4] > scanner.saved(longer.text, TEMPLATES.index(shorter))
    scanner.saved = lambda block, k: 1 if TEMPLATES[k] is shorter else 0
    assert "BSD-2-Clause" in [r[2] for r in scanner.scan(longer.text)]


def test_neighbouring_notices_get_a_row_each():
    notices = [t for t in TEMPLATES if t.name == "notice"]
    text = "\n".join(t.text for t in notices) + "\n" + notices[0].text
    rows = [r for r in Scanner().scan(text) if r[2]]
    assert [r[2] for r in rows] == [t.license for t in notices] + [notices[0].license]
    assert [text[r[0]:r[1]] for r in rows] == text.split("\n")


def test_third_party_notices():
    longer = [t for t in TEMPLATES if t.name in ("permission", "header", "conditions")]
    rows = [r for r in Scanner().scan("\n\n".join(t.text for t in longer)) if r[2]]
    assert [(r[2], r[3], r[5]) for r in rows] == [(t.license, t.name, 1.0) for t in longer]


@pytest.mark.parametrize("template", [t for t in TEMPLATES if len(t.text) > 150], ids=lambda t: f"{t.license}-{t.name}")
@pytest.mark.parametrize("width,gap", [(4, "\n"), (6, "\n"), (9, "\n\n"), (5, "\n\n * ")])
def test_narrow_or_spaced_lines(template, width, gap):
    words = template.text.split()
    text = PROSE + gap.join(" ".join(words[i:i + width]) for i in range(0, len(words), width)) + "\n" + PROSE
    rows = [r for r in Scanner().scan(text) if r[2]]
    assert [(r[2], r[3]) for r in rows] == [(template.license, template.name)]


def test_edges(spark, docs):
    notice = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, "no cue"), (4, notice), (4, notice), (None, notice), (5, "word " * 100_000 + notice + " word" * 100_000),
            (6, notice + "\n" * 9 + "Licensed under CC BY-NC 4.0."), (7, "copyright of nothing in particular")]
    got = sorted(((r.doc_id, r.license) for r in scan_licenses(docs(rows, clash=("license", "start"))).collect()), key=repr)
    assert got == sorted([(4, "MIT"), (4, "MIT"), (None, "MIT"), (5, "MIT"), (6, "MIT"), (6, "CC-BY-NC-4.0"), (7, None)], key=repr)
    assert scan_licenses(docs([])).collect() == []


def test_documents(real):
    """Every notice line of the documents is found, and nothing else is."""
    notices = {t.text: t.license for t in TEMPLATES if t.name == "notice"}
    got = sorted((r.doc_id, r.license) for r in scan_licenses(real("documents")).collect() if r.license)
    assert got == sorted((d.doc_id, name) for d in real("documents").collect() for text, name in notices.items() for _ in range(d.text.count(text)))
