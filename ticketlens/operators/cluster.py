"""Leader clustering of tickets by token overlap, in parallel and exact.

In row order a ticket joins the most similar leader of its category (Jaccard above one half) that shares
an indexed token with it, or becomes a leader itself, whose tokens stay as they are. The leaders are the
first maximal independent set, in row order, of the graph of such pairs, so they can be found in a few
rounds of joins; then every ticket picks its leader by itself. There is no limit on candidates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketlens.plans.shared import checkpoint, forget, numbered, stored

INDEX_SHARE = 0.2
ALWAYS_INDEXED = 2


def token_counts(t: DataFrame) -> DataFrame:
    """(token, df): in how many tickets each token occurs."""
    return t.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def _signatures(t: DataFrame) -> DataFrame:
    """One row for each (category, set of tokens): its first row's number and token order, its indexed and prefix tokens.

    Two sets above one half of Jaccard share one of their rarest ``size - size // 2`` tokens, so joining on
    those finds all pairs, and the most frequent tokens rarely take part.
    """
    rows = t.agg(F.count("*")).first()[0]
    ceiling = max(2, int(rows * INDEX_SHARE))
    sets = t.filter(F.size("tokens") > 0).groupBy("category", F.array_sort("tokens").alias("sorted")).agg(F.min("row_id").alias("sid"), F.min_by("tokens", "row_id").alias("tokens"))
    sets = checkpoint(sets)
    long = sets.select("sid", F.posexplode("tokens").alias("pos", "token")).join(token_counts(t), "token")
    rare = Window.partitionBy("sid").orderBy("df", "pos")
    ranked = long.withColumn("rank", F.row_number().over(rare)).withColumn("by_rarity", F.struct("df", "token"))
    lists = ranked.groupBy("sid").agg(
        F.transform(F.array_sort(F.collect_list(F.when((F.col("rank") <= ALWAYS_INDEXED) | (F.col("df") <= ceiling), F.struct("pos", "token")))), lambda x: x["token"]).alias("indexed"),
        F.transform(F.array_sort(F.collect_list("by_rarity")), lambda x: x["token"]).alias("rarest"),
    )
    size = F.size("rarest")
    out = sets.join(lists, "sid").withColumn("prefix", F.slice("rarest", F.lit(1), size - F.floor(size / 2).cast("int")))
    return checkpoint(out.select("sid", "category", "tokens", "indexed", "prefix"))


def _pairs(sets: DataFrame) -> DataFrame:
    """(a, b, b_sees_a, a_sees_b) with a < b for all pairs above one half; x sees y if it has one of y's indexed tokens."""
    side = sets.select("sid", "category", F.size("tokens").alias("size"), F.explode("prefix").alias("token"))
    a, b = side.alias("a"), side.alias("b")
    near = (F.col("a.sid") < F.col("b.sid")) & (F.least("a.size", "b.size") * 2 > F.greatest("a.size", "b.size"))
    found = a.join(b, (F.col("a.category") == F.col("b.category")) & (F.col("a.token") == F.col("b.token")) & near).select(F.col("a.sid").alias("a"), F.col("b.sid").alias("b")).distinct()
    body = lambda x: sets.select(F.col("sid").alias(x), F.col("tokens").alias(f"{x}_tokens"), F.col("indexed").alias(f"{x}_indexed"))
    both = found.join(body("a"), "a").join(body("b"), "b")
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    both = both.filter(shared * 3 > F.size("a_tokens") + F.size("b_tokens"))
    return both.select("a", "b", F.arrays_overlap("b_tokens", "a_indexed").alias("b_sees_a"), F.arrays_overlap("a_tokens", "b_indexed").alias("a_sees_b"))


def _leaders(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """sids of the leaders: no earlier leader that they see.

    Sets without an open earlier neighbour lead, those who see them follow, and only the pairs among the others
    go on to the next round, as a table of known size.
    """
    edges = stored(pairs.filter("b_sees_a").select("a", "b"))
    led = []
    while not edges.isEmpty():
        heads = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        followers = stored(edges.join(heads, "a", "left_semi").select(F.col("b").alias("sid")).distinct())
        led.append(followers)
        left = stored(edges.join(followers.withColumnRenamed("sid", "b"), "b", "left_anti").join(followers.withColumnRenamed("sid", "a"), "a", "left_anti"))
        forget(edges)
        edges = left
    return sets.select("sid").join(reduce(DataFrame.union, led), "sid", "left_anti") if led else sets.select("sid")


def cluster(t: DataFrame) -> DataFrame:
    """Adds ``cluster_id`` to tickets (row_id unique, category, tokens): ``p-<k>``, k the leader's place among leaders.

    Tickets without tokens are ``solo-<i>``, i their place among all rows. Among leaders of equal
    similarity the one with most shared indexed tokens wins, then the one whose first shared token comes first in
    the ticket, then the earliest.
    """
    rows = checkpoint(t.select("row_id", "category", "tokens"))
    sets = _signatures(rows)
    pairs = checkpoint(_pairs(sets))
    leaders = checkpoint(numbered(_leaders(sets, pairs), ["sid"], "place"))
    see = pairs.filter("b_sees_a").select(F.col("b").alias("sid"), F.col("a").alias("leader")).union(pairs.filter("a_sees_b").select(F.col("a").alias("sid"), F.col("b").alias("leader"))).union(sets.select("sid", F.col("sid").alias("leader")))
    lead = leaders.join(sets, "sid").select(F.col("sid").alias("leader"), "place", F.col("tokens").alias("l_tokens"), F.col("indexed").alias("l_indexed"))
    options = see.join(lead, "leader")
    keyed = rows.filter(F.size("tokens") > 0).withColumn("sorted", F.array_sort("tokens"))
    named = keyed.join(sets.select("category", F.array_sort("tokens").alias("sorted"), "sid"), ["category", "sorted"]).select("row_id", "sid", "tokens")
    picked = named.join(options, "sid").filter("leader <= row_id")
    both = F.size(F.array_intersect("tokens", "l_tokens"))
    met = F.filter("tokens", lambda x: F.array_contains("l_indexed", x))
    picked = picked.select("row_id", "place", "leader", (both / (F.size("tokens") + F.size("l_tokens") - both)).alias("near"), F.size(met).alias("met"), F.array_position("tokens", F.get(met, F.lit(0))).alias("first"))
    best = picked.groupBy("row_id").agg(F.max_by("place", F.struct("near", "met", -F.col("first"), -F.col("leader"))).alias("place"))
    solo = numbered(rows.select("row_id", F.size("tokens").alias("k")), ["row_id"], "i").filter("k = 0").select("row_id", F.concat(F.lit("solo-"), F.col("i").cast("string")).alias("cluster_id"))
    ids = best.select("row_id", F.concat(F.lit("p-"), F.col("place").cast("string")).alias("cluster_id")).union(solo)
    return t.join(ids, "row_id")


def sizes(t: DataFrame, key: Column | str = "cluster_id") -> DataFrame:
    return t.groupBy(key).agg(F.count("*").alias("n"))
