"""Conversations without quotations, ordered by who replies to whom.

1. Lines that begin with ``>`` marks are quoted, as deep as they have marks; consecutive
   lines of one depth form a passage. The lines of depth 0 are a message's own text.
2. Own texts are hashed, normalised, as a whole, by paragraph and by line. Per
   conversation and hash the earliest message is the original: a minimum, so that a line
   that many messages share is one row.
3. Quoted passages are hashed the same way and joined to the originals; each hit weighs
   as many words as it covers. A message replies to the original with the most words of
   its least nested quotations.
4. Pointer doubling over the replies finds each message's first ancestor and depth.

Only DataFrame functions are used. Nothing gathers the messages of a conversation: the
order is given as columns to sort by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.tables import written
from corpusmill.session import ensure_checkpoint_dir

_MARKS = "^((?:[ \\t]{0,3}>)+)"
#: Lines and paragraphs of fewer words say too little to be looked up apart from their passage.
MIN_WORDS = 3


def depth(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", ""))


def normalised(text: Column) -> Column:
    """Lower case, quotation marks gone, everything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def word_number(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def _keys(text: Column) -> Column:
    """The distinct normalised forms of a passage, its paragraphs and its lines, with their words.

    A passage as a whole is looked up however short it is: it may be a whole message.
    """
    parts = F.concat(F.split(text, "\\n[ \\t]*\\n"), F.split(text, "\\n"))
    forms = F.concat(
        F.filter(F.array(normalised(text)), lambda x: x != ""),
        F.filter(F.transform(parts, normalised), lambda x: word_number(x) >= MIN_WORDS))
    return F.transform(F.array_distinct(forms), lambda x: F.struct(F.md5(x).alias("key"), word_number(x).alias("words")))


def messages(conversations: DataFrame) -> DataFrame:
    """(message, conv_id, turn, role, own, quoted): own text and passages (number, depth, text) of each row."""
    rows = written(conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
        F.monotonically_increasing_id().alias("message")), "chat-messages")
    lines = F.transform(F.split(F.regexp_replace("text", "\\r\\n?", "\n"), "\n", -1), lambda x: F.struct(
        depth(x).alias("depth"), F.regexp_replace(x, _MARKS + "[ \\t]?", "").alias("text")))
    cut = rows.withColumn("lines", lines)
    own = F.array_join(F.transform(F.filter("lines", lambda x: x["depth"] == 0), lambda x: x["text"]), "\n")
    # Blank lines at both ends of what is left go with the quotations; other texts stay as they are.
    own = F.when(F.exists("lines", lambda x: x["depth"] > 0), F.regexp_replace(own, "^(?:[ \\t]*\\n)+|(?:\\n[ \\t]*)+$", "")).otherwise(F.col("text"))
    # A passage begins where the depth changes; its text is the lines up to the next one.
    begins = F.filter(F.transform("lines", lambda x, i: F.when((i == 0) | (x["depth"] != F.col("lines")[F.greatest(i - 1, F.lit(0))]["depth"]), i)),
                      lambda i: i.isNotNull())
    quoted = F.transform("begins", lambda b, k: F.struct(
        k.alias("number"), F.col("lines")[b]["depth"].alias("depth"),
        F.array_join(F.transform(F.slice("lines", b + 1, F.coalesce(F.get("begins", k + 1), F.size("lines")) - b), lambda x: x["text"]), "\n").alias("text")))
    return cut.withColumn("begins", begins).select(
        "message", "conv_id", "turn", "role", own.alias("own"), F.filter(quoted, lambda p: p["depth"] > 0).alias("quoted"))


def linked(parts: DataFrame) -> DataFrame:
    """(message, number, depth, words, original): each quoted passage with the turn it comes from, or null."""
    passages = parts.filter(F.size("quoted") > 0).select("message", "conv_id", "turn", F.explode("quoted").alias("p")).select(
        "message", "conv_id", "turn", "p.number", "p.depth", _keys(F.col("p.text")).alias("keys"),
        word_number(normalised(F.col("p.text"))).alias("words"))
    asked = passages.select("message", "conv_id", "turn", "number", F.explode("keys").alias("k")).select(
        "message", "conv_id", "turn", "number", "k.key", "k.words")
    # Only conversations with a quotation are cut into keys.
    wanted = asked.select("conv_id").distinct()
    first = (parts.join(wanted, "conv_id", "left_semi").select("conv_id", "turn", F.explode(_keys(F.col("own"))).alias("k"))
             .groupBy("conv_id", F.col("k.key").alias("key")).agg(F.min("turn").alias("original")))
    votes = (asked.join(first, ["conv_id", "key"]).filter("original < turn")
             .groupBy("message", "number", "original").agg(F.sum("words").alias("votes")))
    best = votes.groupBy("message", "number").agg(F.max_by("original", F.struct("votes", -F.col("original"))).alias("original"))
    return passages.select("message", "number", "depth", "words").join(best, ["message", "number"], "left")


def _roots(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) of every reply, from (conv_id, turn, parent); parents are smaller."""
    ensure_checkpoint_dir(replies.sparkSession)
    now = replies.select("conv_id", "turn", F.col("parent").alias("root_turn"), F.lit(1).alias("depth")).checkpoint()
    while True:
        above = now.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("next"), F.col("depth").alias("more"))
        step = now.join(above, ["conv_id", "root_turn"], "left").select(
            "conv_id", "turn", F.coalesce("next", "root_turn").alias("root_turn"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")).checkpoint()
        now = step.drop("moved")
        if step.filter("moved").isEmpty():
            return now


def threads(conversations: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, content, reply_to, root_turn, depth, n_quotes, n_linked, formatted.

    ``content`` is the message without quotations, ``reply_to`` the turn it answers
    (null if it quotes nothing that is known), ``root_turn`` and ``depth`` its place in
    the reply tree. Sorted by conv_id, root_turn, turn, every message follows what it
    answers and threads stay together. ``formatted`` is the message as a chat segment.

    Null texts give null content and count no quotation. Messages without a conv_id or
    turn are roots and are not linked. A conversation with a turn twice links to the
    turn; its rows are one node. Of originals with equal votes the earliest wins. Empty
    tables give an empty result; other columns are ignored.
    """
    parts = written(messages(conversations), "chat-parts")
    found = written(linked(parts), "chat-links")
    near = Window.partitionBy("message")
    votes = (found.filter("original is not null").withColumn("least", F.min("depth").over(near)).filter("depth = least")
             .groupBy("message", "original").agg(F.sum("words").alias("words")))
    reply = votes.groupBy("message").agg(F.max_by("original", F.struct("words", -F.col("original"))).alias("reply_to"))
    counts = found.groupBy("message").agg(F.count("*").alias("n_quotes"), F.count("original").alias("n_linked"))
    replied = parts.select("message", "conv_id", "turn").join(reply, "message")
    tree = _roots(replied.groupBy("conv_id", "turn").agg(F.min("reply_to").alias("parent")))
    zero = F.lit(0).cast("long")
    return (parts.join(counts, "message", "left").join(reply, "message", "left").join(tree, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", F.col("own").alias("content"), "reply_to", F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("own", F.lit("")), F.lit("<|end|>\n")).alias("formatted")))
