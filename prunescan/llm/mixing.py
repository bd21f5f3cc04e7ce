"""Mixing sources to target weights: multinomial source counts per shard, slots mapped to blocks by per-source index permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from prunescan.llm.common import WORD, cut

#: Rounds of an index permutation, and the prime (2^31 - 1) of the arithmetic that draws their bits in 63 bits.
ROUNDS, PRIME = 20, 2147483647
#: Bins of the slots' range in which a draw looks for its source.
BINS = 1024


def keyed(*parts) -> Column:
    """A portable 52-bit hash of the parts, joined by ``/``."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 13), 16, 10).cast("long")


def turns(n: Column, key: Column) -> Column:
    """The keyed constants of a permutation's rounds: where pairs turn, and what draws their bits."""
    draw = lambda name, k, most: keyed(key, F.lit(name), k) % most
    return F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda k: F.struct(draw("turn", k, n).alias("turn"), draw("a", k, F.lit(PRIME)).alias("a"), draw("b", k, F.lit(PRIME)).alias("b")))


def permuted(i: Column, n: Column, rounds: Column) -> Column:
    """Image of ``i`` under the pseudorandom permutation of 0..n-1 with these rounds (``turns``).

    Swap-or-not rounds, which need no power of two: each pairs every index with its reflection at a keyed place and
    swaps the pair or not by a keyed bit of the pair.
    """

    def swap(x: Column, r: Column) -> Column:
        other = (r["turn"] + n - x) % n
        y = (F.greatest(x, other) % PRIME * r["a"] + r["b"]) % PRIME
        return F.when((y * y + r["b"]) % PRIME % 2 == 1, other).otherwise(x)

    return F.aggregate(rounds, i.cast("long"), swap)


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Words to take from each source: ``source``, ``src``, ``source_size``, ``target``.

    Sources by code point, null last, get ``weights`` in turn and share all words by weight; a target stops at
    ``most`` times its source's size and the excess is shared again by weight. In the order of size over
    weight, the capped sources come first, so one running sum finds where capping ends.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    s = sizes.withColumn("k", F.row_number().over(order) - 1)
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")).cast("double"))
    fill = Window.orderBy(F.col("source_size") / F.col("w"), "k")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumns({
        "level": (F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(after),
        "cap": (F.col("source_size") * most).cast("double"),
    })
    s = s.withColumn("level", F.min(F.when(F.col("w") * F.col("level") <= F.col("cap"), F.struct(F.col("source_size") / F.col("w"), "k", "level"))).over(every)["level"])
    return s.select("source", "src", "source_size", F.coalesce(F.least("cap", F.col("w") * F.col("level")), F.lit(0.0)).alias("target"))


def pack(docs: DataFrame, goal: DataFrame) -> DataFrame:
    """Lay every source's documents end to end: adds ``bucket``, ``rn`` (a row's place in it), ``start`` and the goal's columns.

    Documents are dealt by a hash of their id into about as many buckets as the square root of their number;
    sums are run over a source's buckets and then within each bucket, so no task holds a whole source.
    """
    n = max(1, math.isqrt(docs.count()))
    d = docs.withColumn("bucket", F.pmod(keyed(F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))), F.lit(n)))
    run = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    base = sums.withColumn("base", F.coalesce(F.sum("words").over(run), F.lit(0))).drop("words")
    base = base.join(F.broadcast(goal) if goal.count() <= 10_000 else goal, "src")
    within = Window.partitionBy("src", "bucket").orderBy(F.col("doc_id").isNull(), "doc_id", "tie")
    d = d.join(base, ["src", "bucket"]).withColumn("rn", F.row_number().over(within))
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(before), F.lit(0)))


def shard_counts(goal: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """Slots of every output shard by source: ``shard, src, first, count, n, rounds`` (``first``: the source's slots of the shards before).

    A source of ``n`` blocks is due ``q = round(target / mean block length)`` slots. Every slot of a shard draws its
    source by chance in proportion to the ``q``: it draws a place among all slots and takes the source whose
    range holds it. So a shard's counts are one multinomial draw. Drawn totals miss the targets by chance; the
    running counts of a source are therefore scaled to end at exactly ``q``, which moves a shard's count by little
    and keeps sources at their limit from being drawn too often. A source that no slot drew has its ``q`` dealt evenly.
    """
    g = goal.filter("source_size > 0").withColumn("n", F.ceil(F.col("source_size") / block_words))
    g = g.withColumn("q", F.round(F.col("target") * F.col("n") / F.col("source_size")).cast("long")).filter("q > 0")
    before = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    g = cut(g.withColumns({"low": F.coalesce(F.sum("q").over(before), F.lit(0)), "all": F.sum("q").over(Window.partitionBy())}).select("src", "n", "q", "low", "all"))
    spark = goal.sparkSession
    size = g.agg(F.count("*").alias("sources"), F.coalesce(F.max("all"), F.lit(0)).alias("slots")).first()
    sent = F.broadcast if size.sources <= 10_000 else lambda side: side
    shards, bins = -(-size.slots // shard_slots), max(1, min(BINS, size.slots))
    ranges = g.withColumn("bin", F.explode(F.expr(f"sequence(low * {bins} div all, (low + q - 1) * {bins} div all)")))
    slots = spark.range(0, size.slots, 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    places = slots.select(F.expr(f"id div {shard_slots}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, size.slots))).alias("place"))
    places = places.withColumn("bin", F.expr(f"place * {bins} div {max(1, size.slots)}"))
    drawn = places.join(sent(ranges), "bin").filter("place >= low and place < low + q").groupBy("shard", "src").agg(F.count("*").alias("c"))
    lost = g.join(drawn.select("src").distinct(), "src", "left_anti").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, shards) - 1).cast("long"))).alias("shard"), "src", F.lit(1).cast("long").alias("c"))
    so_far = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = drawn.unionByName(lost).withColumns({"upto": F.sum("c").over(so_far), "total": F.sum("c").over(Window.partitionBy("src"))})
    rounds = turns(F.col("n"), F.concat_ws("/", F.lit(seed), "src")).alias("rounds")
    counts = counts.join(sent(cut(g.select("src", "n", "q", rounds))), "src")
    scaled = lambda upto: F.floor(F.col("q") * upto / F.col("total"))
    counts = counts.withColumns({"first": scaled(F.col("upto") - F.col("c")), "end": scaled(F.col("upto"))})
    return counts.select("shard", "src", "first", (F.col("end") - F.col("first")).alias("count"), "n", "rounds")


def draw(goal: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """The mix, one row per slot of a block: ``shard``, ``src``, ``slot`` (index among its source's), ``block``.

    The shards' counts (``shard_counts``) number a source's slots through. They run through the source's blocks in permuted
    order, so no block is drawn twice before all are drawn once.
    """
    counts = shard_counts(goal, block_words, shard_slots, seed).filter("count > 0")
    parts = int(goal.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number, as few short rows become many
    slots = counts.repartition(parts, "shard", "src").withColumn("slot", F.explode(F.expr("sequence(first, first + count - 1)")))
    block = permuted(F.col("slot") % F.col("n"), F.col("n"), F.col("rounds"))
    return slots.select("shard", "src", "slot", block.alias("block"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block_words: int = 128, shard_slots: int = 8192, seed: int = 42) -> DataFrame:
    """How many words a weighted mix takes from every document: ``doc_id, source, size, source_size, target, taken``.

    ``size`` counts the words of the text; ``taken`` counts words with repeats, at most ``most`` times
    ``size``. Each source's documents are packed end to end (``pack``) and cut into blocks of ``block_words``;
    the mix draws slots shard by shard (``draw``), each naming a block by index; a document takes the sum over
    its pieces of the piece's length times the slots that name the piece's block. As the shards' counts add up to the
    targets, it is not the shard but the number of its source's slots that decides how often a block is taken.

    One row per input row. Repeated rows and null ids are packed one by one; null or empty texts have size 0
    and take 0; a null source is a source of its own, after all others. Nothing depends on where rows lie, so
    reruns agree (rows equal in id and text are interchangeable). Other input columns are not read. An empty
    table gives no rows.
    """
    d = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("src"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("tie"),
    )
    d = cut(d)
    goal = cut(targets(d.groupBy("source", "src").agg(F.sum("size").alias("source_size")), weights, most).drop("source"))
    rows = pack(d, goal)
    blocks = F.expr(f"CASE WHEN size > 0 THEN sequence(start div {block_words}, (start + size - 1) div {block_words}) END")
    pieces = rows.withColumn("block", F.explode_outer(blocks))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest(F.col("start"), F.col("block") * block_words)
    times = draw(goal, block_words, shard_slots, seed).groupBy("src", "block").agg(F.count("*").alias("times"))
    pieces = pieces.withColumn("words", words).join(times.hint("merge"), ["src", "block"], "left")
    taken = F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).alias("taken")
    return pieces.groupBy("src", "bucket", "rn", "doc_id", "source", "size", "source_size", "target").agg(taken).select("doc_id", "source", "size", "source_size", "target", "taken")
