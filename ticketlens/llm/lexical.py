"""Ranked lexical search with geometric blocks of posting lists.

Texts become vectors of term impacts once. They are dealt by a minimum over their terms, so that like texts share a task, and a task
clusters its texts by random projections of their vectors. A term's posting list falls into blocks along these clusters; a block's summary is
the coordinatewise maximum of its texts' vectors, so that a query's product with the summary bounds the score of every text in the block. A
block is skipped only if that bound is below the score that the query's last place already has: that of a share of the texts, ranked
first, or of what the task has seen. The rest is scored exactly, in whole numbers. Summaries are laid out over the terms of the query that
looks at them; a cluster whose own maximum is too low is skipped with all its blocks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketlens.llm.encoder import slices
from ticketlens.llm.rows import documents, keyed
from ticketlens.plans.shared import chunks_for, forget, small_batches, stored

TOP = 50
#: Items are taken in passes of at most so many distinct terms and so many items, which each task holds.
VOCABULARY, ITEMS = 200_000, 50_000
#: Texts, and numbers of their vectors, that a task clusters at once.
SHARD, SHARD_NUMBERS = 8_192, 2_000_000
#: Texts of a cluster, and so of a block at most.
BLOCK = 32
DIMENSIONS, ROUNDS = 32, 3
#: One text in so many is ranked before the others, which gives every item a first bound.
SHARE = 64
SEED = 11

#: What separates terms becomes a space; A-Z become a-z.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and other than ASCII characters, with A-Z lower-cased."""
    return (text or "").encode().translate(_LETTERS).split()


class Queries:
    """Items of one pass: a number for each term, and each item's distinct terms as such numbers."""

    def __init__(self):
        self.ids, self.terms, self.vocabulary = [], [], {}

    def add(self, item_id: int | None, text: str | None) -> None:
        self.ids.append(item_id)
        self.terms.append([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in dict.fromkeys(terms_of(text))])

    @property
    def full(self) -> bool:
        return len(self.vocabulary) >= VOCABULARY or len(self.ids) >= ITEMS


def passes(items: DataFrame) -> Iterator[Queries]:
    now = Queries()
    for row in items.select("item_id", "text").toLocalIterator():
        now.add(row.item_id, row.text)
        if now.full:
            yield now
            now = Queries()
    if now.ids:
        yield now


_VECTORS = "_rid long, doc_id long, n long, near long, terms array<int>, tf array<int>"


def _vectors(vocabulary: dict[bytes, int]):
    """n, the number of terms of a text, and how often it has each term of the vocabulary; near is a minimum over these terms."""
    mixed = np.random.default_rng(SEED).permutation(len(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            sizes, lengths, terms, counts, near = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                words = terms_of(text)
                held = [(k, c) for t, c in Counter(words).items() if (k := vocabulary.get(t)) is not None]
                sizes.append(len(words))
                lengths.append(len(held))
                terms.extend(k for k, _ in held)
                counts.extend(c for _, c in held)
                near.append(int(mixed[[k for k, _ in held]].min()) if held else -1)
            ends = pa.array(np.cumsum([0, *lengths]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("_rid"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(near, pa.int64()), *lists], ["_rid", "doc_id", "n", "near", "terms", "tf"])

    return run


def _held(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["term", "df"])

    return run


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Search:
    """The items of a pass against vectors: ``run`` gives each item's best texts among those of a task."""

    def __init__(self, queries: Queries, df: np.ndarray, texts: int, length: int, least: np.ndarray | None = None, top: int = TOP, skip: bool = True):
        self.texts, self.length, self.top, self.skip, self.size = texts, length, top, skip, len(df)
        self.ids = queries.ids
        self.item = np.repeat(np.arange(len(queries.terms)), list(map(len, queries.terms)))
        self.term = np.array([t for x in queries.terms for t in x], np.int64)
        self.weight = np.array([weight(texts, k) for k in df], np.int64)[self.term] if len(self.term) else self.term
        self.least = np.zeros(len(self.ids), np.int64) if least is None else least
        self.skipped = self.looked = 0

    def clusters(self, edges: np.ndarray, terms: np.ndarray, impact: np.ndarray) -> list[np.ndarray]:
        """The texts (by place) in groups of at most ``BLOCK`` that point in a like direction."""
        n = len(edges) - 1
        signs = np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (self.size, DIMENSIONS))
        places = np.empty((n, DIMENSIONS), np.float32)
        for a in range(0, n, 512):
            b = min(n, a + 512)
            part = slice(edges[a], edges[b])
            places[a:b] = np.add.reduceat(signs[terms[part]] * impact[part, None].astype(np.float32), edges[a:b] - edges[a])
        places /= np.maximum(np.linalg.norm(places, axis=1, keepdims=True), 1e-9)
        centres = places[:: max(1, 4 * BLOCK)].copy()
        for _ in range(ROUNDS):
            own = (places @ centres.T).argmax(1)
            for k in np.unique(own):
                mean = places[own == k].mean(0)
                centres[k] = mean / max(np.linalg.norm(mean), 1e-9)
        order = np.argsort(own, kind="stable")
        cuts = np.flatnonzero(np.diff(own[order])) + 1
        return [run[k : k + BLOCK] for run in np.split(order, cuts) for k in range(0, len(run), BLOCK)]

    def shard(self, best: dict, least: np.ndarray, rids: np.ndarray, docs: np.ndarray, n: np.ndarray, lengths: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> None:
        m = 100 - 50 + (50 * n * self.texts) // self.length
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, lengths))
        edges = np.concatenate([[0], np.cumsum(lengths)])
        column = np.full(self.size, -1, np.int64)
        for group in self.clusters(edges, terms, impact):
            spans = [slice(edges[g], edges[g + 1]) for g in group]
            held = np.concatenate([terms[s] for s in spans])
            own = np.unique(held)
            column[own] = np.arange(len(own))
            vectors = np.zeros((len(group), len(own)), np.int64)
            vectors[np.repeat(np.arange(len(group)), lengths[group]), column[held]] = np.concatenate([impact[s] for s in spans])
            here = np.flatnonzero(column[self.term] >= 0)
            item, at, w = self.item[here], column[self.term[here]], self.weight[here]
            column[own] = -1
            most = np.zeros(len(self.ids), np.int64)
            np.add.at(most, item, w * vectors.max(0)[at])
            starts = np.searchsorted(item, np.arange(len(self.ids) + 1))
            open_ = most >= np.maximum(least, 1) if self.skip else starts[1:] > starts[:-1]
            self.skipped += int(((starts[1:] - starts[:-1]) * ~open_).sum())
            for q in np.flatnonzero(open_).tolist():
                part = slice(starts[q], starts[q + 1])
                mine, weights = vectors[:, at[part]], w[part]
                if self.skip:
                    # a summary for each of the item's terms: the maximum over the texts that hold the term
                    holds = mine > 0
                    bounds = np.where(holds[:, :, None], mine[:, None, :], 0).max(0) @ weights
                    good = bounds >= max(least[q], 1)
                    self.looked += int(good.sum())
                    self.skipped += int((~good).sum())
                    rows = np.flatnonzero(holds[:, good].any(1))
                else:
                    rows = np.arange(len(group))
                score = mine[rows] @ weights
                rows, score = rows[score >= max(least[q], 1)], score[score >= max(least[q], 1)]
                if len(rows):
                    found = np.stack([score, rids[group[rows]], docs[group[rows]]])
                    if q in best:
                        found = np.concatenate([best[q], found], axis=1)
                    found = found[:, np.lexsort((found[1], -found[0]))[: self.top]]
                    best[q] = found
                    if found.shape[1] == self.top:
                        least[q] = found[0, -1]

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        least = self.least.copy()
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            lists = table.column("terms").combine_chunks()
            plain = [table.column(c).to_numpy() for c in ("_rid", "place", "n")]
            self.shard(best, least, *plain, np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().astype(np.int64), table.column("tf").combine_chunks().flatten().to_numpy().astype(np.int64))
            held.clear()

        for batch in batches:
            for a in range(0, batch.num_rows, SHARD // 8):
                held.append(batch.slice(a, SHARD // 8))
                if sum(b.num_rows for b in held) >= SHARD or sum(len(b.column("terms").flatten()) for b in held) >= SHARD_NUMBERS:
                    flush()
        if sum(b.num_rows for b in held):
            flush()
        if best:
            sizes = [x.shape[1] for x in best.values()]
            score, rid, _ = np.concatenate(list(best.values()), axis=1)
            items = np.repeat(np.array(list(best), np.int64), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(items), pa.array([self.ids[k] for k in items], pa.int64()), pa.array(rid), pa.array(score)], ["item", "item_id", "_rid", "score"])


_FOUND = "item long, item_id long, _rid long, score long"


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, skip: bool = True) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best texts of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text).

    Scores are whole numbers; only scores above 0 count, and equal scores rank by ascending doc_id (null first). A null or empty text or item has no terms. Rows with
    a null or repeated doc_id or item_id are rows like others, each ranked for itself. Empty tables give an empty one; other columns are ignored. Without
    ``skip`` every text is scored, with the same result.
    """
    spark = docs.sparkSession
    rows = keyed(docs)
    place = Window.partitionBy("item").orderBy(F.desc("score"), "_rid")
    out = None
    with small_batches(spark):
        for queries in passes(items):
            vectors = stored(rows.select("_rid", F.col("doc_id").cast("long"), "text").mapInArrow(_vectors(queries.vocabulary), _VECTORS))
            texts, length = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
            if not texts or not queries.vocabulary:
                continue
            some = vectors.filter("near >= 0").withColumn("place", F.lit(0).cast("long")).select("_rid", "place", "n", "near", "terms", "tf")
            df = np.zeros(len(queries.vocabulary), np.int64)
            for r in some.select("terms").mapInArrow(_held(len(df)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
                df[r.term] = r.df
            best = lambda frame, search: frame.mapInArrow(search.run, _FOUND).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)
            least = np.zeros(len(queries.ids), np.int64)
            first = best(some.filter(F.pmod(F.xxhash64("_rid"), F.lit(SHARE)) == 0), Search(queries, df, texts, length, top=top, skip=skip))
            for r in first.filter(F.col("rank") == top).select("item", "score").toLocalIterator():
                least[r.item] = r.score
            dealt = some.repartitionByRange(chunks_for(texts, SHARD), "near", "_rid")
            found = best(dealt, Search(queries, df, texts, length, least, top, skip))
            named = stored(found.join(vectors.select("_rid", "doc_id").hint("merge"), "_rid").select("item_id", "rank", "doc_id", "score"))
            forget(vectors)
            out = named if out is None else out.union(named)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op11_lexical(spark, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
i AS MATERIALIZED (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
s AS (SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
c AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * s.n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM c, s GROUP BY term, s.n),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * c.n * s.n) // s.l)))) AS BIGINT) AS score FROM i JOIN c USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
