"""Near-duplicates by SimHash: a binary trie joined with itself.

Fingerprints are sorted into tries, once for each pair of 16-bit quarters that goes first (two
fingerprints at 2 or fewer differing bits agree on two quarters at least, so one of the six tries
holds both under the same 32-bit node). From these nodes downwards pairs of nodes are walked
together, four bits a step, adding up differing bits; a pair over the budget is pruned. A step
is two equi-joins on the node and at most 256 child pairs a pair, so no group of
fingerprints ever meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.rows import documents
from ticketlens.operators.graph import connected_components
from ticketlens.plans.shared import checkpoint, spread_join

MAX_BITS = 2
STEP = 4


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``size`` words of a text, of the whole text if it has fewer words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=False)], np.uint64)


def fingerprint(text: str | None, size: int = 3) -> int:
    """Signed 64-bit SimHash of the XXH64 values (seed 42) of all word shingles of a text."""
    return packed(shingle_hashes(text, size))


def packed(hashes: np.ndarray) -> int:
    """The signed fingerprint of hashes: a bit is 1 if set in over half of them."""
    if not len(hashes):
        return 0
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        bits += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row. Null or empty texts have fingerprint zero."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def _quarters(order: tuple[int, ...], fp: str) -> str:
    """SQL that moves the 16-bit quarters of a long: the quarter order[0] becomes the highest."""
    return " | ".join(f"shiftleft(shiftrightunsigned({fp}, {16 * q}) & 65535L, {48 - 16 * i})" for i, q in enumerate(order))


ORDERS = [(i, j, *[k for k in range(4) if k not in (i, j)]) for i, j in combinations(range(4), 2)]


def _prefix(key: str, depth: int) -> str:
    return f"shiftrightunsigned({key}, {64 - depth})" if depth < 64 else key


def close_pairs(fps: DataFrame, budget: int = MAX_BITS) -> DataFrame:
    """(fp_a, fp_b) for all pairs of different fingerprints at ``budget`` (2 at most) or fewer bits.

    ``fps`` has one column fp; repeats and nulls are ignored.
    """
    if not 0 <= budget <= 2:
        raise ValueError("the quarters prove completeness for 0, 1 or 2 bits only")
    keys = ", ".join(f"struct({r} AS trie, {_quarters(o, 'fp')} AS key)" for r, o in enumerate(ORDERS))
    leaves = fps.filter("fp IS NOT NULL").select("fp").distinct().select(F.explode(F.expr(f"array({keys})")).alias("x")).select("x.*")
    roots = leaves.groupBy("trie", F.expr(_prefix("key", 32)).alias("a")).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    kept = leaves.withColumn("a", F.expr(_prefix("key", 32))).join(roots.hint("merge"), ["trie", "a"], "left_semi").select("trie", "key")
    kept = checkpoint(kept)
    pairs = kept.select("trie", F.expr(_prefix("key", 32)).alias("a")).distinct().select("trie", "a", F.col("a").alias("b"), F.lit(0).alias("bits"))
    side = 1 << STEP
    steps = ", ".join(f"struct({x} AS x, {y} AS y, {(x ^ y).bit_count()} AS d)" for x in range(side) for y in range(side) if (x ^ y).bit_count() <= budget)
    child = f"filter(array({steps}), s -> bits + s.d <= {budget} AND (a <> b OR s.x <= s.y) AND (shiftright(ma, s.x) & 1) = 1 AND (shiftright(mb, s.y) & 1) = 1)"
    for depth in range(32, 64, STEP):
        down = f"CAST({_prefix('key', depth + STEP)} & {side - 1} AS INT)"
        nodes = kept.groupBy("trie", F.expr(_prefix("key", depth)).alias("node")).agg(F.expr(f"bit_or(shiftleft(1, {down}))").alias("mask"))
        # a pair of a node with itself leads somewhere only if two leaves lie below it
        # merge joins: exploded rows have no size that a choice of broadcast could rest on
        pairs = pairs.join(nodes.select("trie", F.col("node").alias("a"), F.col("mask").alias("ma")).hint("merge"), ["trie", "a"])
        pairs = pairs.join(nodes.select("trie", F.col("node").alias("b"), F.col("mask").alias("mb")).hint("merge"), ["trie", "b"])
        pairs = pairs.select("trie", "a", "b", "bits", F.explode(F.expr(child)).alias("s"))
        pairs = pairs.selectExpr("trie", f"shiftleft(a, {STEP}) | s.x AS a", f"shiftleft(b, {STEP}) | s.y AS b", "bits + s.d AS bits")
        if depth + STEP < 64:
            many = kept.groupBy("trie", F.expr(_prefix("key", depth + STEP)).alias("a")).agg(F.count("*").alias("n")).filter("n = 1").drop("n")
            pairs = pairs.filter("a <> b").union(pairs.filter("a = b").join(many.hint("merge"), ["trie", "a"], "left_anti").select("trie", "a", "b", "bits"))
        if depth in (36, 44, 52):
            pairs = checkpoint(pairs)
    undo = "CASE trie " + " ".join(f"WHEN {r} THEN {_quarters(tuple(3 - o.index(3 - i) for i in range(4)), '{0}')}" for r, o in enumerate(ORDERS)) + " END"
    return pairs.filter("a <> b").selectExpr(f"{undo.format('a')} AS fp_a", f"{undo.format('b')} AS fp_b").distinct()


def near_duplicates(docs: DataFrame, budget: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    Documents whose fingerprints differ in ``budget`` or fewer bits are linked; component_id is
    the smallest doc_id that can be reached. Texts without words have fingerprint zero and link
    as any other. A null doc_id gets its component's smallest known doc_id (null if there is
    none); repeated rows give repeated rows; an empty table gives an empty one; other columns are ignored.
    """
    marked = checkpoint(fingerprints(docs))
    known = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    parts = connected_components(close_pairs(marked, budget), "fp_a", "fp_b")
    known = known.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = known.groupBy("component").agg(F.min("first").alias("component_id"))
    known = known.join(least, "component").select("fp", "component_id")
    return spread_join(marked, known, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
