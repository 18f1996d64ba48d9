"""Near copies by MinHash: texts whose sets of word shingles reach a Jaccard similarity share a component.

Every set gets ``MINIMA`` minima under multiply-shift universal hashes. A band of some minima is a key; sets
that share a key are candidates, their signatures (a byte a minimum) estimate the similarity, and whole sets decide.
Equal sets count once. A bucket is never spelled out as pairs: first every member meets the bucket's first text only,
and links so found are joined into components by alternating large-star and small-star. Buckets that still hold
several components are compared inside tasks, in cells of bounded size. A first pass lets only as many of the likely links leave a cell as
join its components. For what is then left apart texts get ``MORE`` further minima, which tell pairs below the similarity from pairs at it
four times as sharply before whole sets are fetched.

Bands have as many minima as a chance of at most ``MISS`` allows that a pair at the similarity shares none of them; its signature
falls short of it by more than ``MARGIN`` standard deviations with a chance of 3e-7.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.encoder import giving_back, slices
from ticketlens.llm.rows import documents, keyed
from ticketlens.llm.simhash import packed, shingle_hashes
from ticketlens.operators.graph import connected_components
from ticketlens.plans.shared import forget, small_batches, spread_join, stored

SIZE, SIMILARITY = 5, 0.85
MINIMA, MORE, MISS, MARGIN = 288, 1_024, 1e-6, 5.0
SEED = 13
#: Bits of the map of ids that tasks hold, 8 MB.
MOST_BITS = 1 << 26
#: Texts of one side of a cell, and signatures that are compared at once.
BLOCK, TILE = 1_024, 64

_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 63, MINIMA + MORE, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, MINIMA + MORE, np.uint64)
_KEY_FACTORS = _RANDOM.integers(0, 1 << 63, MINIMA + MORE, np.uint64) * np.uint64(2) + np.uint64(1)


def minima(hashes: np.ndarray, part: slice = slice(0, MINIMA)) -> np.ndarray:
    """The least 32-bit value of a set of 64-bit hashes under each universal hash."""
    factors, shifts = _FACTORS[part], _SHIFTS[part]
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 256):
        block = hashes[at : at + 256, None] * factors
        block += shifts
        np.minimum(least, block.min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_rows(similarity: float) -> int:
    """Minima of a band: the more, the fewer unlike sets meet."""
    return max([1, *(r for r in range(1, 33) if (1 - similarity**r) ** (MINIMA // r) <= MISS)])


def band_keys(least: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` minima; bands differ in their factors, so keys of two bands do not meet but by chance."""
    used = MINIMA // rows * rows
    key = (least[:used].astype(np.uint64) * _KEY_FACTORS[:used]).reshape(-1, rows).sum(1, dtype=np.uint64)
    key ^= key >> np.uint64(29)
    return (key * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _signed(size: int, band: int, fingerprints: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            rows, keys = [], []
            for text in batch.column("text").to_pylist():
                own = np.unique(shingle_hashes(text, size))
                least = minima(own)
                rows.append((xxhash.xxh128_digest(own.tobytes()), len(own), packed(own) if fingerprints else 0, least.astype(np.uint8).tobytes()))
                keys.append(band_keys(least, band) if len(own) else np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.binary()))]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, lists], ["doc_id", "unit", "n", "fp", "sig", "keys"])

    return run


def signatures(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, fingerprints: bool = False) -> DataFrame:
    """doc_id, unit (a hash of the set of shingles), n (its size), fp (its SimHash, if wanted), sig (a byte a minimum), keys (of its bands)."""
    return docs.select("doc_id", "text").mapInArrow(giving_back(_signed(size, band_rows(similarity), fingerprints)), "doc_id long, unit binary, n long, fp long, sig binary, keys array<long>")


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            sets = [np.unique(shingle_hashes(t, size)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    return run


def _further(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            found = [minima(np.unique(shingle_hashes(t, size)), slice(MINIMA, None)).astype(np.uint8).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["u", "more"])

    return run


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def least_equal(similarity: float, n: int = MINIMA) -> int:
    """Equal bytes of ``n`` that a pair at the similarity has at least, but for a chance of ``MARGIN`` deviations; bytes are equal by chance once in 256."""
    p = similarity + (1 - similarity) / 256
    return math.floor(n * p - MARGIN * math.sqrt(n * p * (1 - p)))


def _allowed(similarity: float):
    least = least_equal(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                equal = (_bytes(batch.column("x")) == _bytes(batch.column("y"))).sum(1)
                yield batch.select(["a", "b"]).filter(pa.array(equal >= least))

    return run


def _alike(similarity: float):
    hundredths = round(similarity * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in ("x", "y"))
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= hundredths * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _slots(ids: pa.Array, bits: int) -> np.ndarray:
    mixed = ids.to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(32)).astype(np.int64) & (bits - 1)


def _marked(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, bool)
        for batch in batches:
            seen[_slots(batch.column("doc_id"), bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], ["bits"])

    return run


def _sieved(seen: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _slots(batch.column("doc_id"), 8 * len(seen))
            yield batch.filter(pa.array(seen[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1, pa.bool_()))

    return run


def picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) whose doc_id is in ``ids`` (doc_id, distinct, stored), without a shuffle of all texts.

    A bitmap of 16 bits an id, ``MOST_BITS`` at most, spares most of the other texts before the exact join; with more ids it spares fewer.
    """
    n = ids.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
    seen = np.zeros(bits // 8, np.uint8)
    for row in ids.coalesce(8).mapInArrow(_marked(bits), "bits binary").toLocalIterator():
        seen |= np.frombuffer(row.bits, np.uint8)
    return docs.select("doc_id", "text").mapInArrow(_sieved(seen), "doc_id long, text string").join(ids, "doc_id", "left_semi")


class Confirmed:
    """Confirms pairs (a, b) of doc_ids on whole sets. Only texts of some pair are cut into shingles, each once."""

    def __init__(self, docs: DataFrame, size: int, similarity: float):
        self.docs, self.size, self.similarity, self.made = docs, size, similarity, []

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """The pairs that reach the similarity, as a stored table. ``pairs`` must be stored, too."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        for old in self.made:
            ids = ids.join(old.select("doc_id"), "doc_id", "left_anti")
        ids = stored(ids)
        self.made.append(stored(picked(self.docs, ids).mapInArrow(giving_back(_sets(self.size)), "doc_id long, shingles binary")))
        forget(ids)
        sets = reduce(DataFrame.union, self.made)
        side = lambda key, name: sets.select(F.col("doc_id").alias(key), F.col("shingles").alias(name)).hint("merge")
        return stored(pairs.join(side("b", "y"), "b").join(side("a", "x"), "a").mapInArrow(giving_back(_alike(self.similarity)), "a long, b long"))


def _grouped(units: DataFrame, links: list[DataFrame]) -> DataFrame:
    """(u, component) of every unit: the smallest u that the links reach, itself where there are none."""
    parts = connected_components(reduce(DataFrame.union, links), "a", "b").withColumnRenamed("node", "u")
    return stored(units.select("u").join(parts, "u", "left").select("u", F.coalesce("component", "u").alias("component")))


def _compared(similarity: float, likely: bool):
    """(a, b) of different components that may be similar by all bytes of their signatures; rows come cell by cell.

    Of ``likely`` links, those halfway between what is allowed and equality, only as many are given as join the cell's components.
    """
    least = least_equal(similarity)
    least = least + MINIMA >> 1 if likely else least

    def told(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs of whole signatures have enough equal bytes."""
        enough = least_equal(similarity, x.shape[1])
        return np.concatenate([np.zeros(0, bool), *[(x[k : k + 4_096] == y[k : k + 4_096]).sum(1) >= enough for k in range(0, len(x), 4_096)]])

    def cell(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        side, u, component = (part.column(c).to_numpy() for c in ("side", "u", "component"))
        two = np.flatnonzero(side != side[0])
        if not len(two) and not part.column("within")[0].as_py():
            return
        sig, root = _bytes(part.column("sig")), component.copy()
        rows, others = (np.flatnonzero(side == side[0]), two) if len(two) else (np.arange(len(u)), np.arange(len(u)))
        for at in range(0, len(rows), TILE):
            tile = rows[at : at + TILE]
            equal = np.zeros((len(tile), len(others)), np.int16)
            for k in range(0, MINIMA, 48):  # bytes in a few portions, so that what is compared at once stays small
                equal += (sig[tile, None, k : k + 48] == sig[None, others, k : k + 48]).sum(2, dtype=np.int16)
            i, j = np.nonzero((equal >= least) & (component[tile, None] != component[None, others]))
            i, j = tile[i], others[j]
            if likely:
                kept = []
                for x in np.unique(i).tolist():
                    near = j[i == x]
                    near = near[root[near] != root[x]]
                    roots, first = np.unique(root[near], return_index=True)
                    kept += [(x, y) for y in near[first].tolist()]
                    root[np.isin(root, roots)] = root[x]
                i, j = np.array(kept, np.int64).reshape(-1, 2).T
            else:
                keep = np.ones(len(i), bool) if len(two) else u[i] < u[j]
                i, j = i[keep], j[keep]
                good = told(sig[i], sig[j])
                i, j = i[good], j[good]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u[i], u[j])), pa.array(np.maximum(u[i], u[j]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            ids = np.column_stack([held.column(c).to_numpy() for c in ("key", "i", "j")])
            cuts = [0, *(np.flatnonzero((np.diff(ids, axis=0) != 0).any(1)) + 1).tolist()]
            for start, stop in zip(cuts, cuts[1:], strict=False):  # the last cell may go on in the next batch
                yield from cell(held.slice(start, stop - start).combine_chunks().to_batches()[0])
            held = held.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield from cell(held.combine_chunks().to_batches()[0])

    return run


def _cells(posts: DataFrame, block: int) -> DataFrame:
    """``posts`` (key, u, component) of buckets with several components, dealt into cells (key, i, j) of some 2 * ``block`` rows.

    Components of more than ``block`` members in a bucket are cut into parts, each of which meets parts of the bucket's other members but never
    its own component; the members of small components are dealt by component and meet in pairs of parts.
    """
    each = posts.groupBy("key", "component").agg(F.count("*").alias("k"))
    large = F.col("k") > block
    rule = each.groupBy("key").agg(
        F.count("*").alias("components"), F.ceil(F.sum("k") / block).alias("whole"),
        F.greatest(F.ceil(F.sum(F.when(large, 0).otherwise(F.col("k"))) / block), F.lit(1)).alias("parts"),
        F.collect_list(F.when(large, F.struct("component", F.ceil(F.col("k") / block).alias("parts")))).alias("giants"),
    ).filter("components > 1").drop("components")
    mixed = posts.join(rule.hint("merge"), "key").withColumn("own", F.expr("get(filter(giants, g -> g.component = component), 0)"))
    mixed = mixed.withColumns({"part": F.expr("pmod(xxhash64(component), parts)"), "place": F.expr("pmod(xxhash64(u), whole)")})
    small = "transform(sequence(0L, parts - 1), o -> struct(least(part, o) AS i, greatest(part, o) AS j, part AS side, part = o AS within))"
    mine = "transform(sequence(0L, whole - 1), o -> struct(component AS i, -1L - pmod(xxhash64(u), own.parts) * whole - o AS j, -1L AS side, false AS within))"
    met = "flatten(transform(filter(giants, g -> g.component <> component AND (own IS NULL OR g.component < component)), g -> transform(sequence(0L, g.parts - 1), s -> struct(g.component AS i, -1L - s * whole - place AS j, 0L AS side, false AS within))))"
    return mixed.select("key", "u", "component", F.explode(F.expr(f"concat(if(own IS NULL, {small}, {mine}), {met})")).alias("c")).select("key", "u", "component", "c.*")


def similar_groups(docs: DataFrame, size: int, similarity: float, empties_linked: bool = False, first=None, block: int = BLOCK) -> DataFrame:
    """(doc_id, n, component_id) for every row of ``docs`` (doc_id, unique and not null, and text).

    n is the size of the set of distinct ``size``-word shingles; a text with fewer words is one shingle, one without words has none and
    is linked with nothing, or with its like if ``empties_linked``. component_id is the smallest doc_id that can be reached. ``first``, if
    given, is called with (units, confirmed) and returns links (a, b) that are known before bands are compared.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    with small_batches(docs.sparkSession):
        rows = stored(signatures(docs, size, similarity, first is not None))
        heads = rows.groupBy("unit").agg(F.min("doc_id").alias("u"))
        units = stored(rows.select("doc_id", "n", "fp", "sig", "keys").join(heads.select(F.col("u").alias("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "u"))
        confirmed = Confirmed(docs, size, similarity)
        links = [first(units, confirmed)] if first else []
        # every member of a bucket meets its first text
        posts = units.select("u", F.explode("keys").alias("key"))
        buckets = posts.groupBy("key").agg(F.min("u").alias("lead"), F.count("*").alias("k")).filter("k > 1").drop("k")
        posts = stored(posts.join(buckets.hint("merge"), "key"))
        sigs = lambda key, name: units.select(F.col("u").alias(key), F.col("sig").alias(name)).hint("merge")
        star = posts.filter("u <> lead").select(F.col("lead").alias("a"), F.col("u").alias("b")).distinct()
        seen = stored(star.join(sigs("b", "y"), "b").join(sigs("a", "x"), "a").mapInArrow(giving_back(_allowed(similarity)), "a long, b long"))
        links.append(confirmed(seen))
        # buckets that hold several components
        for likely in (True, False):
            known = _grouped(units, links)
            held = posts.select("key", "u").join(known.hint("merge"), "u")
            mixed = held.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
            held = stored(held.join(mixed.hint("merge"), "key", "left_semi"))
            signed, more = units.select("u", "sig"), None
            if not likely:
                apart = stored(held.select(F.col("u").alias("doc_id")).distinct())
                more = stored(picked(docs, apart).mapInArrow(giving_back(_further(size)), "u long, more binary"))
                forget(apart)
                signed = signed.join(more, "u").select("u", F.concat("sig", "more").alias("sig"))
            cells = _cells(held, block).join(signed.hint("merge"), "u")
            cells = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(giving_back(_compared(similarity, likely)), "a long, b long").distinct()
            fresh = stored(cells.join(seen.hint("merge"), ["a", "b"], "left_anti"))
            links.append(confirmed(fresh))
            seen = seen.union(fresh)
            forget(held, more)
        known = _grouped(units, links)
        forget(posts)
    named = rows.select("doc_id", "unit", "n")
    known = stored(heads.join(known, "u").select("unit", F.col("component").alias("component_id")))
    forget(units, *confirmed.made)
    out = spread_join(named, known, "unit").select("doc_id", "n", "component_id")
    return out if empties_linked else out.withColumn("component_id", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")))


def near_duplicates(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Texts are linked at a Jaccard similarity of ``similarity`` (in hundredths) or more over their sets of distinct ``size``-word shingles, lower-cased; a
    text with fewer words is one shingle. Null texts and texts without words have no shingle and link with nothing.
    component_id is the smallest doc_id reachable. Rows with null or repeated doc_ids count by themselves: a component is named by the doc_id of its
    first row (null first), and kept is true for that row only. An empty table gives an empty one; other columns are ignored.
    """
    rows = keyed(docs)
    found = similar_groups(rows.select(F.col("_rid").alias("doc_id"), "text"), size, similarity).withColumnRenamed("doc_id", "_rid")
    if rows.select(F.count_if(F.col("doc_id").isNull()) == 0, F.count("*") == F.count_distinct("doc_id")).first() == (True, True):
        return found.select(F.col("_rid").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", (F.col("_rid") == F.col("component_id")).alias("kept"))
    ids = rows.select("_rid", "doc_id")
    found = found.join(ids, "_rid")
    return spread_join(found, ids.select(F.col("_rid").alias("component_id"), F.col("doc_id").alias("_named")), "component_id").select("doc_id", F.col("n").alias("n_shingles"), F.col("_named").alias("component_id"), (F.col("_rid") == F.col("component_id")).alias("kept"))


def op13_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
