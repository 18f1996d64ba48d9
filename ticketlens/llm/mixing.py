"""Mixing sources to target weights, by DataFrame operations only.

Each source's words are laid in a row, document after document, and cut into blocks of a fixed
length. The output is shards of a fixed number of slots. Every slot of a shard draws its source by the
target weights, so a shard's counts of the sources are one multinomial draw; the few slots that a source then
has beyond its target go to the sources that lack some, so that each ends at its target. The slots of a
source are numbered over all shards, and slot t takes the block that a pseudorandom permutation of the
source's block numbers puts at t (anew for each pass over the source). Slots join blocks by (source,
block number), and blocks join documents by the words that they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketlens.llm.rows import documents, folded, keyed, unfolded, word_count, word_list
from ticketlens.plans.shared import checkpoint, chunks_for, prefix_sum

BLOCK = 128
MOST = 3
SEED = 20_240
#: Slots of an output shard (about 131,000 words), slots that a task makes, shards summed at once, and equal shares that weights are cut into.
SHARD_SLOTS = 1_024
TASK_SLOTS = 20_000
CHUNK_SHARDS = 4_096
CELLS = 65_536
ROUNDS = 12


def targets(sizes: DataFrame, weights: Column | None = None, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target) from one row (source, source_size) for each source.

    Targets share the total by weight; none is above ``most`` times its source, and what is over
    goes to the others by weight. In the order of limit over weight the capped sources come
    first, so one running sum finds them. Default weights are 1, 2, 3, repeating, by code point,
    null last. The table has a row for each source, not for each document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    out = sizes.withColumn("weight", weights if weights is not None else ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    out = out.withColumn("_cap", most * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total, all_weight = Window.partitionBy(F.lit(0)), F.sum("weight").over(Window.partitionBy(F.lit(0)))
    left = F.sum(F.col("source_size").cast("double")).over(total) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    open_weight = all_weight - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    out = out.withColumn("_level", left / open_weight)
    out = out.withColumn("_capped", F.col("_cap") <= F.col("_level") * F.col("weight"))
    level = F.min(F.when(~F.col("_capped"), F.struct(F.col("_cap") / F.col("weight"), "_level"))).over(total)["_level"]
    return out.withColumn("target", F.when(F.col("_capped"), F.col("_cap")).otherwise(level * F.col("weight"))).select("source", "source_size", "weight", "target")


def _permuted(i: Column, n: Column, key: Column) -> Column:
    """A number in [0, n) for each i in [0, n), all different: a swap-or-not shuffle of any length n.

    A round mirrors i at a keyed point and keeps i or its mirror image by a bit of the larger
    of the two, so both members of a pair decide alike (Hoang, Morris, Rogaway, CRYPTO 2012).
    """

    def turn(x: Column, r: Column) -> Column:
        y = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.pmod(F.xxhash64(key, r, F.greatest(x, y)), F.lit(2)) == 0, y).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), i.cast("long"), turn)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _cells(wanted: DataFrame) -> DataFrame:
    """(cell, k): CELLS equal shares of the weights, dealt to the sources by their slots; a table of a fixed size."""
    before = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    low = F.coalesce(F.sum("slots").over(before), F.lit(0)) / F.greatest(F.sum("slots").over(Window.partitionBy(F.lit(0))), F.lit(1))
    edges = wanted.withColumn("_low", F.ceil(low * CELLS)).withColumn("_high", F.ceil((low + F.col("slots") / F.greatest(F.sum("slots").over(Window.partitionBy(F.lit(0))), F.lit(1))) * CELLS))
    return edges.filter("_high > _low").select("k", F.explode(F.expr("sequence(CAST(_low AS INT), CAST(_high AS INT) - 1)")).alias("cell")).filter(f"cell < {CELLS}")


def drawn(wanted: DataFrame, seed: int, shard_slots: int) -> DataFrame:
    """(k, shard, t): the slots of each source k, numbered from 0 to its ``slots`` - 1, and their output shards.

    ``wanted`` has a row (k, slots) for each source. The first draw is one row a slot in as many tasks as the number of slots asks for.
    """
    total = wanted.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    shards = -(-total // shard_slots)
    if not shards:
        return wanted.select("k", F.lit(0).cast("long").alias("shard"), F.col("slots").alias("t")).limit(0)
    spark = wanted.sparkSession
    tasks = int(max(1, min(shards, -(-total // TASK_SLOTS))))
    slots = spark.range(0, int(shards), 1, tasks).select(F.col("id").alias("shard"), F.explode(F.expr(f"sequence(0L, least({shard_slots}L, {total}L - id * {shard_slots}L) - 1)")).alias("j"))
    slots = slots.withColumn("cell", F.pmod(F.xxhash64("shard", "j", F.lit(seed)), F.lit(CELLS)).cast("int"))
    slots = slots.join(F.broadcast(_cells(wanted)), "cell").select("shard", "j", "k")
    # the first number of each (shard, source), then the place inside
    counts = checkpoint(slots.groupBy("shard", "k").agg(F.count("*").alias("n")))
    firsts = prefix_sum(counts, ["k"], F.col("n"), ["shard"], "base", F.floor(F.col("shard") / CHUNK_SHARDS))
    inside = F.row_number().over(Window.partitionBy("shard", "k").orderBy("j")) - 1
    slots = slots.withColumn("inside", inside).join(firsts.select("shard", "k", "base").hint("merge"), ["shard", "k"]).select("shard", "k", (F.col("base") + F.col("inside")).alias("t"))
    got = counts.groupBy("k").agg(F.sum("n").alias("got"))
    ends = wanted.join(got, "k", "left").select("k", "slots", F.coalesce("got", F.lit(0)).alias("got"))
    by_k = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    ends = checkpoint(ends.withColumn("over", F.coalesce(F.sum(F.greatest(F.col("got") - F.col("slots"), F.lit(0))).over(by_k), F.lit(0))).withColumn("lack", F.coalesce(F.sum(F.greatest(F.col("slots") - F.col("got"), F.lit(0))).over(by_k), F.lit(0))))
    named = slots.join(F.broadcast(ends.select("k", "slots", "got", "over")), "k")
    # what a source has beyond its target comes from anywhere among its slots
    named = named.withColumn("t", F.when(F.col("got") > F.col("slots"), _permuted(F.col("t"), F.col("got"), F.xxhash64("k", F.lit(seed), F.lit("spare")))).otherwise(F.col("t")))
    stay = named.filter("t < slots").select("k", "shard", "t")
    spare = named.filter("t >= slots").select("shard", (F.col("over") + F.col("t") - F.col("slots")).alias("r"))
    # the numbers that sources lack, a row each, meet the spare slots in order
    runs = ends.filter("slots > got").withColumn("run", F.explode(F.expr(f"sequence(0L, (slots - got - 1) div {TASK_SLOTS})"))).repartition("k", "run")
    open_ = runs.withColumn("i", F.explode(F.expr(f"sequence(run * {TASK_SLOTS}, least((run + 1) * {TASK_SLOTS}, slots - got) - 1)")))
    moved = spare.join(open_.select("k", (F.col("got") + F.col("i")).alias("t"), (F.col("lack") + F.col("i")).alias("r")).hint("merge"), "r")
    return stay.union(moved.select("k", "shard", "t"))


def block_plan(sized: DataFrame, seed: int, block: int, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame]:
    """(documents with their place, one row for each slot) of ``sized`` (_rid, doc_id, source, size)."""
    rows = sized.count()
    chunk = F.pmod(F.xxhash64("_rid", F.lit(seed)), F.lit(chunks_for(rows)))
    placed = prefix_sum(sized, ["source"], F.col("size"), ["_rid"], "first", chunk)
    wanted = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    placed = placed.join(wanted.withColumnRenamed("source", "_s"), _same("source", "_s"), "left").drop("_s", "weight")
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    slots = F.least(F.round(F.col("target") * blocks / F.greatest("source_size", F.lit(1))).cast("long"), MOST * blocks)
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    wanted = checkpoint(wanted.select("source", place.alias("k"), blocks.alias("n"), slots.alias("slots")).filter("slots > 0"))
    draws = drawn(wanted.select("k", "slots"), seed, shard_slots).join(F.broadcast(wanted.select("k", "source", "n")), "k")
    return placed, draws.select("source", "shard", "t", _permuted(F.expr("t % n"), F.col("n"), F.xxhash64("source", F.expr("t div n"), F.lit(seed))).alias("block"))


def mixed(docs: DataFrame, seed: int = SEED, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes.

    ``docs`` needs doc_id, text, source. Size is the number of words (null text: 0). A block is
    drawn 3 times at most, since a source has at most 3 slots a block; the last block of a source
    may be short. Null is a source of its own. Rows with equal doc_ids count each by itself; the
    draw depends on the seed, the source's name and the words before, so reruns agree. Documents
    without words take none; an empty table gives an empty one.
    """
    placed, draws = block_plan(_sized(docs), seed, block, shard_slots)
    return _taken(placed, draws, block).select("doc_id", "size", "source_size", "target", "taken")


def _sized(docs: DataFrame) -> DataFrame:
    return checkpoint(keyed(docs, F.col("source")).select("_rid", "doc_id", "source", word_count(F.col("text")).alias("size")))


def _pieces(placed: DataFrame, draws: DataFrame, block: int) -> DataFrame:
    """_rid, block, and times drawn: the documents' parts that some slot takes."""
    times = draws.groupBy(F.col("source").alias("_s"), "block").agg(F.count("*").alias("times"))
    cut = placed.filter("size > 0").select("_rid", "source", "first", "size", F.explode(F.expr(f"sequence(first div {block}, (first + size - 1) div {block})")).alias("_b"))
    # Spark takes exploded rows for as few as their source, so it must not pick a broadcast by size here
    return cut.join(times.hint("merge"), _same("source", "_s") & (F.col("_b") == F.col("block")))


def _taken(placed: DataFrame, draws: DataFrame, block: int) -> DataFrame:
    inside = F.least(F.col("first") + F.col("size"), (F.col("_b") + 1) * block) - F.greatest(F.col("first"), F.col("_b") * block)
    sums = _pieces(placed, draws, block).groupBy("_rid").agg(F.sum(inside * F.col("times")).alias("taken"))
    return placed.join(sums.hint("merge"), "_rid", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir))


def _word_pieces(docs: DataFrame, placed: DataFrame, draws: DataFrame, block: int, *columns: Column) -> DataFrame:
    """One row for each document that the mix takes: its columns, and its parts in order.

    ``pieces`` has (block, first word, number of words, times) of each; a document's own length bounds it.
    """
    low = F.greatest(F.col("first"), F.col("_b") * block)
    high = F.least(F.col("first") + F.col("size"), (F.col("_b") + 1) * block)
    parts = _pieces(placed, draws, block).select("_rid", F.struct(F.col("_b").alias("block"), (low - F.col("first") + 1).cast("int").alias("at"), (high - low).cast("int").alias("n"), F.col("times").cast("int").alias("times"), "size").alias("p"))
    grouped = parts.groupBy("_rid").agg(F.array_sort(F.collect_list("p")).alias("pieces"))
    return keyed(docs, *columns).join(grouped.hint("merge"), "_rid")


def mixed_blocks(docs: DataFrame, seed: int = SEED, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, source, t, block, words: the mix itself, a row for each slot, by output shard.

    ``words`` are the block's words in order, ``block`` of them but in a source's last block.
    """
    placed, draws = block_plan(_sized(docs), seed, block, shard_slots)
    rows = _word_pieces(docs, placed, draws, block, F.col("source")).withColumn("_words", word_list(F.col("text")))
    rows = rows.join(placed.select("_rid", "first"), "_rid")
    cut = rows.select(F.col("source").alias("_s"), "first", "_words", F.explode("pieces").alias("p"))
    cut = cut.select("_s", F.col("p.block").alias("_b"), "first", F.slice("_words", F.col("p.at"), F.col("p.n")).alias("w"))
    whole = cut.groupBy("_s", "_b").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "w"))), lambda x: x["w"])).alias("words"))
    return draws.join(whole.hint("merge"), _same("source", "_s") & (F.col("block") == F.col("_b"))).select("shard", "source", "t", "block", "words")


def mixed_documents(docs: DataFrame, seed: int = SEED, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The columns of ``docs`` for every document that the mix takes words of; ``text`` is what it takes.

    A document taken whole keeps its text as it is, once for each time; of others the taken words
    follow in order, each part as often as it is drawn. n_chars, if there, is the new length. Other columns
    of any name stay as they are.
    """
    placed, draws = block_plan(_sized(docs), seed, block, shard_slots)
    rows = _word_pieces(docs, placed, draws, block, folded(docs))
    one = F.size(F.array_distinct(F.transform("pieces", lambda p: p["times"]))) == 1
    every = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["n"]) == F.get("pieces", F.lit(0))["size"]
    whole = F.array_join(F.array_repeat(F.col("text"), F.get("pieces", F.lit(0))["times"]), "\n")
    parts = rows.withColumn("_words", word_list(F.col("text"))).withColumn("_whole", F.when(one & every, whole))
    text = F.array_join(F.flatten(F.transform("pieces", lambda p: F.array_repeat(F.array_join(F.slice("_words", p["at"], p["n"]), " "), p["times"]))), " ")
    return unfolded(parts.withColumn("text", F.coalesce("_whole", text)), docs, n_chars=F.length("text"))
