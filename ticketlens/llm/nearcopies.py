"""Near copies for the pipeline: the fingerprint trie first, what it leaves by bands of minima, whole sets decide.

The trie join on SimHash fingerprints links the closest copies. Texts at a similarity of 0.8 differ in up to a
dozen of 64 bits, which no walk of tries can afford, so the rest is found by ``minhash.similar_groups``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.minhash import Confirmed, similar_groups
from ticketlens.llm.simhash import close_pairs
from ticketlens.plans.shared import stored

SIZE = 5
SIMILARITY = 0.8


def trie_links(units: DataFrame, confirmed: Confirmed) -> DataFrame:
    """(a, b) of different sets, confirmed, that the trie brings together: a fingerprint's first set with its others and with that of each close fingerprint."""
    lead = units.groupBy("fp").agg(F.min("u").alias("lead"))
    near = units.select("u", "fp").join(lead.hint("merge"), "fp").filter("u <> lead").select(F.col("lead").alias("a"), F.col("u").alias("b"))
    end = lambda fp, name: lead.select(F.col("fp").alias(fp), F.col("lead").alias(name)).hint("merge")
    ends = close_pairs(units.select("fp")).join(end("fp_a", "p"), "fp_a").join(end("fp_b", "q"), "fp_b")
    return confirmed(stored(near.union(ends.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))).distinct()))


def near_copies(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs`` (doc_id, unique and not null, and text).

    Texts whose sets of ``size``-word shingles have a Jaccard similarity of at least ``similarity``
    are linked; component_id is the smallest doc_id that can be reached. A shorter text is one
    shingle, and texts without words have equal, empty sets. Shingles are told by 64-bit
    hashes, equal sets by 128-bit hashes. ``docs`` is read several times.
    """
    return similar_groups(docs, size, similarity, empties_linked=True, first=trie_links).select("doc_id", "component_id")
