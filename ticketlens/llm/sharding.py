"""Sharding by balanced label propagation.

Linked documents share a group. A round counts each group's members by shard, picks the
shard that holds most of a group (of those with room), and moves the others there as long as the
quota, counted after the round's departures, lasts; so full shards exchange equal numbers. Every move
puts more pairs of a group together, so rounds end; they do so when nothing moves any more. Documents without links are dealt last and fill every shard to its exact quota, so
counts differ by one at most whatever the links are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.rows import documents, keyed
from ticketlens.plans.shared import HOT_ROWS, chunks_for, forget, prefix_sum, spread_join, stored

SHARDS = 16
#: Far more rounds than moves last; beyond them an error is raised.
ROUNDS = 200
#: Rounds without a move, each with ties drawn anew, after which nothing is left to move.
STILL = 2
SEED = 77


def _hashed(chunks: int, salt: int) -> Column:
    return F.pmod(F.xxhash64("_rid", F.lit(salt)), F.lit(chunks))


def _by_table(values: dict[int, int], key: Column, default: int = 0) -> Column:
    """Looks a key up in a table with an entry for each shard."""
    pairs = [F.lit(x) for kv in sorted(values.items()) for x in kv]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default)) if pairs else F.lit(default)


def quotas(rows: int, shards: int) -> dict[int, int]:
    return {s: rows // shards + (s < rows % shards) for s in range(shards)}


def accepted(wanted: dict[tuple[int, int], int], room: dict[int, int]) -> dict[tuple[int, int], int]:
    """How many of the ``wanted`` moves (from, to) can be made at once so that no shard gains more than its ``room``."""
    take, gain = dict(wanted), dict.fromkeys(room, 0)
    for (s, t), k in take.items():
        gain[s], gain[t] = gain[s] - k, gain[t] + k
    while (over := max(gain, key=lambda t: (gain[t] - room[t], -t), default=None)) is not None and gain[over] > room[over]:
        # what stays away is taken from the shard that can best keep it
        s = max((s for (s, t), k in take.items() if t == over and k), key=lambda s: (room[s] - gain[s], -s))
        spare = room[s] - gain[s]
        k = min(take[s, over], gain[over] - room[over], spare if spare > 0 else wanted[s, over])
        take[s, over] -= k
        gain[s], gain[over] = gain[s] + k, gain[over] - k
    return take


def propagate(linked: DataFrame, quota: dict[int, int], rounds: int = ROUNDS) -> DataFrame:
    """(_rid, group, shard) of ``linked`` (_rid unique, group not null); no shard is above its quota.

    Each round is three shuffles of narrow rows: counts by (group, shard), which are summed
    before they move; the join of members with their group's choice; and the rank of the
    moves from one shard to another, in chunks. A group of any size is spread over tasks. What the driver holds is a number for each pair of
    shards. Raises an error if moves go on after ``rounds`` rounds.
    """
    shards = len(quota)
    n = linked.count()
    chunks = chunks_for(n)
    state = prefix_sum(linked, [], F.lit(1), ["_rid"], "_at", _hashed(chunks, SEED)).select("_rid", "group", (F.col("_at") % shards).cast("int").alias("shard"))
    state = stored(state)
    still = 0
    hot = (state.groupBy("group").count().agg(F.max("count")).first()[0] or 0) > HOT_ROWS
    size = {s: k for s, k in state.groupBy("shard").count().collect()}
    for r in range(rounds):
        room = {s: quota[s] - size.get(s, 0) for s in quota}
        held = state.groupBy("group", "shard").agg(F.count("*").alias("n"))
        # the fullest shard of a group; among equals, one picked by the group and the round
        best = held.groupBy("group").agg(F.max(F.struct((_by_table(room, F.col("shard")) > 0).cast("int").alias("open"), "n", F.xxhash64("group", "shard", F.lit(r)).alias("tie"), "shard")).alias("b")).select("group", F.col("b.shard").alias("to"), F.col("b.n").alias("lead"))
        # members of a group in one shard move alike, so the choice is a row for each (group, shard)
        place = F.struct("group", "shard").alias("place")
        choice = held.join(best, "group").filter("shard <> to AND lead >= n").select(place, "to")
        moves = state.withColumn("place", place)
        moves = (spread_join(moves, choice, "place", "inner", held.select(place, F.col("n").alias("_k"))) if hot else moves.join(choice, "place")).select("_rid", "shard", "to")
        moves = stored(moves)
        take = accepted({(s, t): k for s, t, k in moves.groupBy("shard", "to").count().collect()}, room)
        moved = sum(take.values())
        if moved:
            for (s, t), k in take.items():
                size[s], size[t] = size[s] - k, size.get(t, 0) + k
            ranked = prefix_sum(moves, ["shard", "to"], F.lit(1), ["_rid"], "_rank", _hashed(max(1, chunks // shards), SEED + r + 1))
            taken = ranked.filter(F.col("_rank") < _by_table({s * shards + t: k for (s, t), k in take.items()}, F.col("shard") * shards + F.col("to"))).select("_rid", "to")
            before, state = state, stored(state.join(taken, "_rid", "left").select("_rid", "group", F.coalesce("to", "shard").alias("shard")))
            forget(before)
        forget(moves)
        still = 0 if moved else still + 1
        if not n or still == STILL:
            return state
    raise RuntimeError(f"labels still move after {rounds} rounds")


def sharded(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs`` (doc_id, text).

    Law ``rows``: counts differ by one at most. Equal texts are linked. size is the text's UTF-8
    bytes plus 1 (null text: 1), text_crc32 that of its UTF-8 bytes (null: of none), slot a
    number from 0 without gaps in each shard, grown_shard null. Null and repeated doc_ids are
    rows like others; a group larger than a shard's quota is split over several shards; an empty
    table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    mark = F.xxhash64(F.crc32(F.encode(text, "UTF-8")), text, F.lit(1))
    rows = stored(keyed(docs).select("_rid", "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.struct(F.xxhash64(text).alias("a"), mark.alias("b")).alias("group")))
    n = rows.count()
    quota = quotas(n, shards)
    groups = stored(rows.groupBy("group").agg(F.count("*").alias("_k")).filter("_k > 1"))
    linked = propagate(spread_join(rows.select("_rid", "group"), groups.select("group"), "group", "left_semi", groups), quota, rounds)
    size = {s: k for s, k in linked.groupBy("shard").count().collect()}
    free = {s: quota[s] - size.get(s, 0) for s in quota}
    chunks = chunks_for(n)
    single = prefix_sum(rows.join(linked, "_rid", "left_anti").select("_rid"), [], F.lit(1), ["_rid"], "_at", _hashed(chunks, SEED))
    shard, end = F.lit(None).cast("int"), 0
    for s in sorted(free):
        end += free[s]
        shard = F.coalesce(shard, F.when(F.col("_at") < end, F.lit(s)))
    placed = linked.select("_rid", "shard").union(single.select("_rid", shard.alias("shard")))
    placed = prefix_sum(placed, ["shard"], F.lit(1), ["_rid"], "slot", _hashed(max(1, chunks // shards), SEED))
    return rows.join(placed, "_rid").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def cut_links(placed: DataFrame) -> DataFrame:
    """One row: pairs of linked documents (text_crc32 as the group), and those in two shards."""
    pairs = lambda n: n * (n - 1) / 2
    inside = placed.groupBy("text_crc32", "shard").agg(F.count("*").alias("n")).groupBy("text_crc32").agg(F.sum("n").alias("n"), F.sum(pairs(F.col("n"))).alias("kept"))
    return inside.agg(F.sum(pairs(F.col("n"))).alias("links"), F.sum(pairs(F.col("n")) - F.col("kept")).alias("cut"))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir))
