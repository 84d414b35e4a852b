"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words. Each source gets a target share of the mix; a source may be used up to
``max_repeats`` times, each use an epoch of its own. A source's documents fall into
disjoint blocks by a hash, of ``block_words`` words on average; the blocks are put in a pseudo-random order per epoch, and
the epoch draws whole blocks until its target, cutting the last one between documents.

The drawn blocks of every source and epoch form exact quotas. A binary tree deals them
to the output shards: at each node the number of blocks of each source that go left is
a multivariate hypergeometric draw (one hypergeometric draw per source, in order, by the
inverse of its distribution), so that shards get equal numbers of blocks and the counts
add up exactly. Shards then take disjoint runs of the permuted blocks and shuffle their
documents locally. All randomness comes from hashes with a seed: reruns agree.

Only DataFrame operations are used. Documents are never ranked as a whole: a source's
blocks are ordered in two steps, over buckets of the permutation and within a bucket,
and only the documents of a cut block are ordered. Windows over sources see one row per
source, and a tree node holds one number per source and epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import ensure_checkpoint_dir

SHARE = 1.5
MAX_REPEATS = 2
SHARD_WORDS = 20_000_000
BLOCK_WORDS = 500_000
BLOCK_DOCS = 50_000
SEED = 20
#: Block and source tables up to this many rows (about 100 bytes each) are sent to the documents.
MAX_BROADCAST_ROWS = 300_000
#: Matches the bytes between words.
_WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text (null: 0): runs become one letter each, then everything else goes."""
    marked = F.regexp_replace(F.regexp_replace(text, _WORD, "x"), "[\\x20\\x09-\\x0D]+", "")
    return F.coalesce(F.length(marked), F.lit(0)).cast("long")


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of the parts."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double")
    return (bits + 0.5) / float(1 << 53)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = SHARE,
            max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row per source.

    Sources in code point order, null last, take the weights in turn. Each gets its part
    of ``share`` times all sizes, at most ``max_repeats`` times its own size; what a
    source cannot take goes to the others by weight until none is above. Sorted by
    size over weight the full sources come first, so one running sum finds them.
    """
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source").asc_nulls_last())
    places = F.array(*[F.lit(float(w)) for w in weights])
    weighed = (sizes.withColumn("place", F.row_number().over(order) - 1)
               .withColumn("weight", F.element_at(places, (F.col("place") % len(weights) + 1).cast("int")))
               .withColumn("most", F.lit(float(max_repeats)) * F.col("source_size"))
               .withColumn("all", F.lit(float(share)) * F.sum("source_size").over(everything)))
    by_fill = everything.orderBy(F.col("most") / F.col("weight"), "place")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
             / F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
    levelled = weighed.withColumn("level", level).withColumn(
        "open", F.col("level") * F.col("weight") <= F.col("most"))
    found = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(
        by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levelled.select(
        "source", F.col("source_size").cast("long").alias("source_size"), "weight",
        F.least("most", F.coalesce(found * F.col("weight"), F.col("most"))).alias("target"))


def _hypergeometric(good: Column, bad: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``drawn`` from good + bad are good, by inversion; all columns are long.

    Probabilities relative to the mode's follow from one another, upwards and then
    downwards from the mode, within 12 standard deviations and some, beyond which they
    vanish in double precision. One fold sums them, a second finds where ``uniform``
    falls among them in that order.
    """
    low = F.greatest(F.lit(0).cast("long"), drawn - bad)
    high = F.least(good, drawn)
    mode = F.least(high, F.greatest(low, F.floor((drawn + 1) * ((good + 1) / (good + bad + 2))).cast("long")))
    n = (good + bad).cast("double")
    spread = F.ceil(12 * F.sqrt(drawn * (good / n) * (bad / n))).cast("long") + 20
    empty = F.array().cast("array<bigint>")
    last, first = F.least(high, mode + spread), F.greatest(low, mode - spread)
    up = F.when(last > mode, F.sequence(mode + 1, last)).otherwise(empty)
    down = F.when(mode > first, F.sequence(mode - 1, first, F.lit(-1).cast("long"))).otherwise(empty)

    def up_ratio(x: Column) -> Column:
        return ((good - x + 1) * (drawn - x + 1)).cast("double") / (x * (bad - drawn + x))

    def down_ratio(x: Column) -> Column:
        return ((x + 1) * (bad - drawn + x + 1)).cast("double") / ((good - x) * (drawn - x))

    def folded(values: Column, ratio, start: Column, goal: Column) -> Column:
        begin = F.struct(F.lit(1.0).alias("w"), start["sum"].alias("sum"), start["found"].alias("found"))
        return F.aggregate(values, begin, lambda s, x: F.struct(
            (s["w"] * ratio(x)).alias("w"), (s["sum"] + s["w"] * ratio(x)).alias("sum"),
            F.when(s["found"].isNull() & (s["sum"] + s["w"] * ratio(x) >= goal), x).otherwise(s["found"]).alias("found")))

    none = F.lit(None).cast("long")

    def walked(goal: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("sum"), F.when(goal <= 1.0, mode).otherwise(none).alias("found"))
        return folded(down, down_ratio, folded(up, up_ratio, start, goal), goal)

    total = walked(F.lit(float("inf")))["sum"]
    # One fold over a single element binds the goal, which the search uses at each step.
    value = F.transform(F.array(total * uniform), lambda goal: F.coalesce(walked(goal)["found"], mode))[0]
    return (F.when((good <= 0) | (drawn <= 0), F.lit(0).cast("long"))
            .when(bad <= 0, F.least(good, drawn)).otherwise(value))


def split_tree(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(shard, source_no, epoch, blocks) from quotas (source_no, epoch, blocks), counts exact.

    A node is one row: its shards and the quotas it holds. Each level draws the left
    child's quotas with probability proportional to the ways of choosing them; shards
    differ by at most one block.
    """
    node = quotas.groupBy().agg(
        F.sort_array(F.collect_list(F.struct("source_no", "epoch", F.col("blocks").cast("long").alias("blocks")))).alias("quotas")).select(
        F.lit(0).alias("shard"), F.lit(int(shards)).alias("width"), "quotas")
    ensure_checkpoint_dir(quotas.sparkSession)
    total = F.aggregate("quotas", F.lit(0).cast("long"), lambda s, q: s + q["blocks"])
    for level in range(max(0, (int(shards) - 1).bit_length())):
        half = F.floor(F.col("width") / 2).cast("int")
        # Blocks are dealt to shards as evenly as whole numbers allow.
        drawn = F.floor(total * half / F.greatest(F.col("width"), F.lit(1))).cast("long")
        start = F.struct(total.alias("rest"), drawn.alias("drawn"), F.array().cast(
            "array<bigint>").alias("left"))

        def step(s: Column, q: Column) -> Column:
            take = _hypergeometric(q["blocks"], s["rest"] - q["blocks"], s["drawn"], _uniform(
                F.lit(seed), F.lit(level), F.col("shard"), q["source_no"], q["epoch"]))
            # ``take`` is a large expression used three times: bind it once.
            bound = F.transform(F.array(take), lambda t: F.struct(
                (s["rest"] - q["blocks"]).alias("rest"), (s["drawn"] - t).alias("drawn"),
                F.concat(s["left"], F.array(t)).alias("left")))
            return bound[0]

        left = F.aggregate("quotas", start, step, lambda s: s["left"])
        node = node.withColumn("left", F.when(F.col("width") > 1, left)).select(F.explode(F.when(
            F.col("width") > 1, F.array(
                F.struct(F.col("shard"), half.alias("width"), _with_blocks(lambda q, i: F.col("left")[i]).alias("quotas")),
                F.struct((F.col("shard") + half).alias("shard"), (F.col("width") - half).alias("width"),
                         _with_blocks(lambda q, i: q["blocks"] - F.col("left")[i]).alias("quotas")))).otherwise(
            F.array(F.struct("shard", "width", "quotas")))).alias("n")).select("n.*")
        # A level's draws must not be computed again by every level below it.
        node = node.checkpoint()
    return node.select("shard", F.explode("quotas").alias("q")).select(
        "shard", "q.source_no", "q.epoch", "q.blocks").filter("blocks > 0")


def _with_blocks(count) -> Column:
    return F.transform("quotas", lambda q, i: F.struct(
        q["source_no"].alias("source_no"), q["epoch"].alias("epoch"), count(q, i).alias("blocks")))


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents with their words (mix_size) and a hash of id and text (mix_hash)."""
    return docs.withColumns({
        "mix_size": word_count(F.col("text")),
        "mix_hash": F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))})


class Plan:
    """What a mix takes: targets per source and the drawn blocks with their shards."""

    def __init__(self, sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = SHARE,
                 max_repeats: int = MAX_REPEATS, shards: int | None = None, block_words: int = BLOCK_WORDS,
                 shard_words: int = SHARD_WORDS, seed: int = SEED):
        """``sizes``: a cheap table (source, mix_size, mix_hash) of all documents."""
        self.seed, self.max_repeats = seed, max_repeats
        totals = sizes.groupBy("source").agg(
            F.sum("mix_size").alias("source_size"), F.count("*").alias("docs"))
        # One row per source; small as the sources are few, and checkpointed to be read often.
        ensure_checkpoint_dir(sizes.sparkSession)
        full = targets(totals.select("source", "source_size"), weights, share, max_repeats)
        self.sources = (full.withColumn("_k", F.struct("source")).join(
                totals.select(F.struct("source").alias("_k"), "docs"), "_k").drop("_k")
            .withColumn("source_no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())))
            .withColumn("block_count", (F.ceil(F.col("source_size") / block_words) + F.floor(F.col("docs") / BLOCK_DOCS)).cast("long"))
            .withColumn("block_count", F.greatest(F.col("block_count"), F.lit(1).cast("long"))).checkpoint())
        taken, self.source_count = self.sources.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count("*")).first()
        self.shards = shards or max(1, -(-int(taken) // shard_words))
        self.draws = self._draws(sizes).checkpoint()
        self.draw_count = self.draws.count()

    def placed(self, docs: DataFrame) -> DataFrame:
        """Sized documents with the number of their source and their block."""
        known = self.sources.select(F.col("source").alias("mix_source"), "source_no", "block_count",
                                    F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
        if self.source_count <= MAX_BROADCAST_ROWS:
            known = F.broadcast(known)
        return (docs.join(known, F.col("source").eqNullSafe(F.col("mix_source"))).drop("mix_source")
                .withColumn("block", F.pmod(F.xxhash64(F.lit(self.seed + 1), "mix_hash"), "block_count")).drop("block_count"))

    def _draws(self, sizes: DataFrame) -> DataFrame:
        blocks = self.placed(sizes).groupBy("source_no", "block").agg(F.sum("mix_size").alias("words"))
        epochs = F.explode(F.sequence(F.lit(0), F.lit(self.max_repeats - 1))).alias("epoch")
        known = self.sources.select("source_no", "source_size", "target", "block_count", epochs).select(
            "source_no", "epoch", "block_count",
            F.greatest(F.lit(0.0), F.least(F.col("source_size").cast("double"), F.col("target") - F.col("epoch") * F.col("source_size"))).alias("goal"))
        permuted = (blocks.join(known.filter("goal > 0"), "source_no")
                    .withColumn("u", _uniform(F.lit(self.seed + 2), "source_no", "epoch", "block"))
                    .withColumn("bucket", F.floor(F.col("u") * F.ceil(F.sqrt("block_count")))))
        group = ["source_no", "epoch", "bucket"]
        before = Window.partitionBy("source_no", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        buckets = permuted.groupBy(group).agg(F.sum("words").alias("w"), F.count("*").alias("n")).select(
            *group, F.coalesce(F.sum("w").over(before), F.lit(0)).alias("words_before"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_before"))
        inside = Window.partitionBy(group).orderBy("u", "block")
        drawn = (permuted.join(buckets, group)
                 .withColumn("after", F.col("words_before") + F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
                 .withColumn("rank", F.col("rank_before") + F.row_number().over(inside))
                 .withColumn("room", F.col("goal") - (F.col("after") - F.col("words")))
                 .filter("room > 0")
                 .select("source_no", "epoch", "block", "rank",
                         F.when(F.col("room") < F.col("words"), F.col("room")).alias("room")))
        quotas = drawn.groupBy("source_no", "epoch").agg(F.count("*").alias("blocks"))
        tree = split_tree(quotas, self.shards, self.seed)
        run = Window.partitionBy("source_no", "epoch").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        ranks = tree.withColumn("start", F.coalesce(F.sum("blocks").over(run), F.lit(0))).select(
            "source_no", "epoch", "shard", F.explode(F.sequence(F.col("start") + 1, F.col("start") + F.col("blocks"))).alias("rank"))
        return drawn.join(ranks, ["source_no", "epoch", "rank"]).select("source_no", "block", "epoch", "shard", "room")

    def copies(self, docs: DataFrame) -> DataFrame:
        """One row per copy taken: the columns of ``placed`` with mix_epoch and mix_shard."""
        draws = self.draws.select("source_no", "block", F.col("epoch").alias("mix_epoch"), F.col("shard").alias("mix_shard"), "room")
        if self.draw_count <= MAX_BROADCAST_ROWS:
            draws = F.broadcast(draws)
        rows = docs.join(draws, ["source_no", "block"])
        line = Window.partitionBy("source_no", "block", "mix_epoch").orderBy(
            F.xxhash64(F.lit(self.seed + 3), "mix_epoch", "mix_hash"), "mix_hash").rowsBetween(Window.unboundedPreceding, 0)
        # Of a cut block: the documents that fit in order, then the one that best fills the gap.
        whole = Window.partitionBy("source_no", "block", "mix_epoch")
        off = F.abs(F.col("mix_size") - F.col("gap"))
        nearest = whole.orderBy("fits", off, F.xxhash64("mix_epoch", "mix_hash"), "mix_hash")
        cut = (rows.filter("room is not null")
               .withColumn("after", F.sum("mix_size").over(line)).withColumn("fits", F.col("after") <= F.col("room"))
               .withColumn("gap", F.col("room") - F.coalesce(F.max(F.when(F.col("fits"), F.col("after"))).over(whole), F.lit(0)))
               .withColumn("number", F.row_number().over(nearest))
               .filter(F.col("fits") | ((F.col("number") == 1) & (off <= F.col("gap")))).drop("after", "fits", "gap", "number"))
        return rows.filter("room is null").unionByName(cut).drop("room")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix: a row per copy taken, all columns of ``docs`` with mix_epoch, mix_shard, mix_block.

    Rows come partitioned by shard, in the shard's local shuffle order. Options are those
    of ``Plan``. A null text counts 0 words; null sources are one source, the last; a
    document of 0 words is taken with its block. Repeated rows are documents of their
    own; a null doc_id is allowed. An empty table gives an empty mix. Columns of
    ``docs`` that have the name of a mix column are replaced.
    """
    own = [c for c in docs.columns if c not in ("mix_epoch", "mix_shard", "mix_block")]
    seed = options.get("seed", SEED)
    # Working names that a column of the input could clash with are taken from a struct.
    packed = docs.select(F.struct(*own).alias("mix_row"), "doc_id", "source", "text")
    ready = sized(packed, seed).drop("doc_id", "text")
    plan = Plan(ready.select("source", "mix_size", "mix_hash"), **options)
    rows = plan.copies(plan.placed(ready))
    return (rows.repartition(plan.shards, "mix_shard")
            .sortWithinPartitions("mix_shard", F.xxhash64(F.lit(seed + 4), "mix_epoch", "mix_hash"))
            .select("mix_row.*", "mix_epoch", "mix_shard", F.col("block").alias("mix_block")))
