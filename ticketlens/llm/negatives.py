"""Hard negatives by Kronecker-packed products.

Rows are dealt into blocks. Of a block, one component of all rows is packed into one wide integer: every value gets a bias that
makes it positive and a field wide enough for a whole score. Multiplying that integer by an anchor's (biased) component
multiplies all fields at once; after one multiplication a component, the sum's fields are the block's scores, from which
the biases are taken off exactly. Anchors come in chunks, and a chunk meets a block once: first the blocks of its
label for the positives, then all blocks for the negatives. What a task has seen of a chunk is merged before it leaves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketlens.plans.shared import forget, small_batches, spread_join, stored

SCALE = 256
#: Components saturate here (values of 65,536 and more), so that scores fit 64 bits.
LARGEST = 1 << 24
ANCHORS_EVERY, MOVED_EVERY, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: Negatives have this share of the positive's score, in percent.
LEAST, MOST = 50, 95
#: Rows of a block and anchors of a chunk, fewer if vectors are long; blocks whose results a task merges.
BLOCK, CHUNK, BLOCK_BYTES, GROUP = 1_024, 256, 1 << 22, 32


def components(vector: Column) -> Column:
    """floor(256 * x) of every component, as int."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))


def usable(vectors: DataFrame) -> DataFrame:
    """rid, vec_id, label, x of the rows that take part, stored; every seventh label is moved on by one."""
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    label, vec_id = F.col("label").cast("long"), F.col("vec_id").cast("long")
    return stored(rows.select(F.monotonically_increasing_id().alias("rid"), vec_id.alias("vec_id"), F.when(vec_id % MOVED_EVERY == 0, (label + 1) % LABELS).otherwise(label).alias("label"), components(F.col("embedding")).alias("x")))


def _matrix(lists: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of ``width`` numbers, shorter ones filled up with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


class Fields:
    """How values are packed: ``bias`` makes them positive, fields of ``size`` bytes hold the sum of ``width`` products."""

    def __init__(self, width: int, largest: int):
        self.width, self.bias = width, largest
        self.size = next(s for s in (4, 8, 16) if 4 * width * largest * largest < 1 << 8 * s)
        self.block = max(16, min(BLOCK, BLOCK_BYTES // max(1, width * self.size)))
        self.chunk = max(4, min(CHUNK, BLOCK_BYTES // max(1, width * 8)))

    def packed(self, x: np.ndarray) -> bytes:
        """The wide integers of all components, one after another, little-endian."""
        fields = np.zeros((self.width, len(x), self.size // 4), "<u4")
        fields[:, :, 0] = (x + self.bias).T
        return fields.tobytes()

    def integers(self, data: bytes, rows: int) -> list[int]:
        step = rows * self.size
        return [int.from_bytes(data[k * step : (k + 1) * step], "little") for k in range(self.width)]

    def scores(self, anchor: list[int], wide: list[int], rows: int, sums: np.ndarray) -> np.ndarray:
        """The inner products of one anchor with all rows of a block: one multiplication for each component."""
        total = 0
        for a, w in zip(anchor, wide, strict=True):
            total += (a + self.bias) * w
        fields = np.frombuffer(total.to_bytes(rows * self.size, "little"), f"<u{min(self.size, 8)}")
        biased = fields[:: max(1, self.size // 8)].astype(np.uint64).view(np.int64)
        return biased - self.bias * (sums + sum(anchor)) - self.width * self.bias * self.bias


def _first(score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Where the first ``most`` are: highest scores, then smallest ids."""
    at = np.arange(len(score))
    if len(score) > 4 * most:
        at = np.flatnonzero(score >= np.partition(score, len(score) - most)[len(score) - most])
    return at[np.lexsort((ids[at], -score[at]))[:most]]


def _blocks(fields: Fields):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        x = _matrix(table.column("x"), fields.width)
        plain = {c: table.column(c).to_numpy().astype("<i8").tobytes() for c in ("rid", "vec_id", "label")}
        out = {"bucket": key[0], "chunks": key[1], "groups": key[2], "part": key[3], "rids": plain["rid"], "ids": plain["vec_id"], "labels": plain["label"], "sums": x.sum(1).astype("<i8").tobytes(), "fields": fields.packed(x)}
        return pa.table({k: [v if isinstance(v, bytes) else v.as_py()] for k, v in out.items()}, schema=pa.schema([(k, pa.binary() if isinstance(v, bytes) else pa.int64()) for k, v in out.items()]))

    return run


def _met(fields: Fields, pick: Callable, most: int):
    """(anchor, pos, id, score): what ``pick`` finds for the anchors of each chunk in the blocks it meets, the first ``most`` for each (anchor, pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        now = None

        def merged() -> Iterator[pa.RecordBatch]:
            if best:
                sizes = [len(s) for s, _ in best.values()]
                keys = np.repeat(np.array(list(best), np.int64), sizes, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1].astype(np.int32)), *[pa.array(np.concatenate([v[k] for v in best.values()])) for k in (1, 0)]], ["anchor", "pos", "id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["bucket"], row["chunk"], row["group"])
                if key != now:
                    yield from merged()
                    best, now = {}, key
                rids, ids, labels, sums = (np.frombuffer(row[c], "<i8") for c in ("rids", "ids", "labels", "sums"))
                wide = fields.integers(row["fields"], len(ids))
                for anchor in row["anchors"]:
                    x = anchor["x"] + [0] * (fields.width - len(anchor["x"]))
                    score = fields.scores(x, wide, len(ids), sums)
                    for pos, mask in pick(anchor, score, rids, labels):
                        s, i = score[mask], ids[mask]
                        if (old := best.get((anchor["rid"], pos))) is not None:
                            if len(old[0]) == most and len(s):
                                good = s >= old[0][-1]
                                s, i = s[good], i[good]
                            if not len(s):
                                continue
                            s, i = np.concatenate([old[0], s]), np.concatenate([old[1], i])
                        at = _first(s, i, most)
                        best[anchor["rid"], pos] = (s[at], i[at])
        yield from merged()

    return run


def _positive(anchor: dict, score: np.ndarray, rids: np.ndarray, labels: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    yield 0, rids != anchor["rid"]


def _negative(anchor: dict, score: np.ndarray, rids: np.ndarray, labels: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    other = labels != anchor["label"]
    for w in anchor["wanted"]:
        least, most = -(-LEAST * w["score"] // 100), MOST * w["score"] // 100
        if least <= most:
            yield w["pos"], other & (score >= least) & (score <= most)


def _search(rows: DataFrame, anchors: DataFrame, bucket: Column, fields: Fields, pick: Callable, most: int) -> DataFrame:
    """(anchor, pos, rank, id, score): the first ``most`` rows that ``pick`` allows each anchor, among the rows of its bucket."""
    rows, anchors = rows.withColumn("bucket", bucket), anchors.withColumn("bucket", bucket)
    rule = rows.groupBy("bucket").agg(F.count("*").alias("n")).join(anchors.groupBy("bucket").agg(F.count("*").alias("m")), "bucket")
    parts = F.ceil(F.col("n") / fields.block)
    rule = stored(rule.select("bucket", parts.alias("parts"), F.ceil(F.col("m") / fields.chunk).alias("chunks"), F.ceil(parts / GROUP).alias("groups")))
    dealt = spread_join(rows, rule, "bucket").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")))
    kind = "bucket long, chunks long, groups long, part long, rids binary, ids binary, labels binary, sums binary, fields binary"
    blocks = dealt.select("bucket", "chunks", "groups", "part", "rid", "vec_id", "label", "x").groupBy("bucket", "chunks", "groups", "part").applyInArrow(_blocks(fields), kind)
    blocks = blocks.withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)"))).withColumn("group", F.pmod("part", "groups")).drop("chunks", "groups", "part")
    dealt = spread_join(anchors, rule, "bucket").withColumn("chunk", F.pmod(F.xxhash64("rid", F.lit(1)), F.col("chunks")))
    chunks = dealt.groupBy("bucket", "chunk", "groups").agg(F.collect_list(F.struct("rid", "label", "x", "wanted")).alias("anchors"))
    chunks = chunks.withColumn("group", F.explode(F.expr("sequence(0L, groups - 1)"))).drop("groups")
    met = blocks.join(chunks.hint("merge"), ["bucket", "chunk", "group"]).mapInArrow(_met(fields, pick, most), "anchor long, pos int, id long, score long")
    place = Window.partitionBy("anchor", "pos").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= most)


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``vectors`` (vec_id, embedding, label).

    Rows with a null vec_id, label or vector, or a null or non-finite component take no part. Anchors are rows whose vec_id is divisible by
    50, their positives the first 5 other rows of their label, the negatives of a positive the first 3 of other labels with
    50 to 95 % of its score; first is by score, then by smaller vec_id. Shorter vectors count as filled up with zeros, empty ones score 0. Rows with a
    repeated vec_id are rows of their own, so an id may be its own anchor's positive. A positive without negatives, and so
    a negative or zero score (but for negatives of exactly 0), gives no row; an empty table gives an empty one. Other columns are ignored.
    """
    with small_batches(vectors.sparkSession, 64):
        rows = usable(vectors)
        width, largest = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0)), F.coalesce(F.max(F.expr("array_max(transform(x, v -> abs(v)))")), F.lit(1))).first()
        fields = Fields(width, max(1, largest))
        anchors = rows.filter(F.col("vec_id") % ANCHORS_EVERY == 0)
        nothing = F.lit(None).cast("array<struct<pos:int,score:bigint>>")
        positives = stored(_search(rows, anchors.withColumn("wanted", nothing), F.col("label"), fields, _positive, POSITIVES).select("anchor", F.col("rank").alias("pos"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
        wanted = positives.groupBy(F.col("anchor").alias("rid")).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("positive_score").alias("score")))).alias("wanted"))
        found = stored(_search(rows, anchors.join(wanted, "rid"), F.lit(0).cast("long"), fields, _negative, NEGATIVES))
        named = found.join(positives, ["anchor", "pos"]).join(anchors.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
        out = stored(named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        forget(found, positives, rows)
        return out


def op12_negatives(spark, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same rows in SQL, for tables whose vec_ids tell rows apart.
OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor, other, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5)
SELECT p.anchor AS anchor_id, p.other AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other) QUALIFY row_number() OVER w <= 3
"""
