"""Threads with known quotations."""

from __future__ import annotations

import pytest

from corpusmill.llm.quotations import threads

CHAT = "conv_id long, turn long, role string, text string"
FIRST = "Hello there, this is the first message.\n\nIt has two paragraphs, as you can see."


@pytest.fixture(scope="module")
def run(spark):
    def call(rows, clash=()):
        from pyspark.sql import functions as F
        df = spark.createDataFrame(rows, CHAT).withColumns({c: F.lit("x") for c in clash})
        return {(r.conv_id, r.turn): r for r in threads(df).collect()}

    return call


def test_thread(run):
    got = run([
        (1, 0, "user", FIRST),
        (1, 1, "assistant", "> Hello there, this is the first message.\n\nThanks for it, dear friend of mine."),
        (1, 2, "user", ">> Hello there, this is the first message.\n> Thanks for it, dear friend of mine.\n\nYou are very welcome here."),
        (1, 3, "user", "> it has two paragraphs,\n> as you can SEE\nIndeed it does have two of them.\n> unknown words that nobody said\nwell"),
        (1, 4, "user", "no quotation here"),
        (2, 0, "user", "> Hello there, this is the first message.\nother conversation")], clash=("content", "root_turn", "message"))
    assert [(got[1, t].reply_to, got[1, t].root_turn, got[1, t].depth, got[1, t].n_quotes, got[1, t].n_linked) for t in range(5)] == [
        (None, 0, 0, 0, 0), (0, 0, 1, 1, 1), (1, 0, 2, 2, 2), (0, 0, 1, 2, 1), (None, 4, 0, 0, 0)]
    assert [got[1, t].content for t in range(5)] == [
        FIRST, "Thanks for it, dear friend of mine.", "You are very welcome here.", "Indeed it does have two of them.\nwell", "no quotation here"]
    assert got[2, 0].reply_to is None and got[2, 0].content == "other conversation"
    assert got[1, 1].formatted == "<|assistant|>\nThanks for it, dear friend of mine.<|end|>\n"


def test_long_chain_and_hot_line(run):
    rows = [(1, 0, "user", "message number zero of this chain")]
    rows += [(1, i, "user", f"> message number {'zero' if i == 1 else i - 1} of this chain\nthe line that everybody writes\nmessage number {i} of this chain") for i in range(1, 40)]
    rows += [(1, 100 + i, "user", "> the line that everybody writes\nyes indeed") for i in range(30)]
    got = run(rows)
    assert [(got[1, i].root_turn, got[1, i].depth) for i in range(40)] == [(0, i) for i in range(40)]
    assert all((got[1, 100 + i].reply_to, got[1, 100 + i].depth) == (1, 2) for i in range(30))


def test_short_messages_are_found_as_a_whole(run):
    got = run([
        (1, 0, "user", "Shall we begin with the first of them now?"), (1, 1, "assistant", "Yes, agreed."), (1, 2, "user", "Why not?\n\nIt is a longer message here."),
        (1, 3, "user", "> yes agreed\nGood."), (1, 4, "user", "> Why not?\nA line of a longer message is too short alone."), (1, 5, "user", "> Good\n> !\nfine"), (1, 6, "user", "> ...\nnothing")])
    assert [got[1, t].reply_to for t in range(7)] == [None, None, None, 1, None, 3, None]


def test_edges(run, spark):
    got = run([(1, 0, "user", None), (1, 1, None, ""), (None, 2, "user", "> Some words that are quoted\nown"), (3, None, "user", "plain"),
               (4, 0, "user", "\n\nkeeps its\n\n\nblank lines \n"), (4, 1, "user", ">>> \n>"), (5, 0, "user", "word " * 50_000)])
    assert got[1, 0].content is None and got[1, 1].content == "" and got[1, 1].formatted.startswith("<|unknown|>")
    assert (got[None, 2].content, got[None, 2].reply_to, got[3, None].root_turn) == ("own", None, None)
    assert got[4, 0].content == "\n\nkeeps its\n\n\nblank lines \n"
    assert (got[4, 1].content, got[4, 1].n_linked) == ("", 0)
    assert threads(spark.createDataFrame([], CHAT)).collect() == []


def test_repeated_rows_stay(spark):
    rows = [(1, 0, "user", "the very first words here")] * 2 + [(1, 1, "user", "> the very first words here\nreply")] * 2
    got = threads(spark.createDataFrame(rows, CHAT)).collect()
    assert sorted((r.turn, r.reply_to, r.n_linked) for r in got if r.turn) == [(1, 0, 1)] * 2 and len(got) == 4


def test_all_conversations(real):
    rows = real("conversations")
    got = threads(rows)
    assert got.count() == rows.count()
    assert got.join(rows, ["conv_id", "turn", "role"]).filter("content = text").count() == rows.count()
