"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are its own shape (lengths, shares of classes of
characters, repeats) and that of the lines around it; weights on neighbouring labels tie the lines
together. Forward-backward gives each line's marginal, and a document's score is the mean of its
lines' marginals, weighted by length. Training maximises the likelihood of a bounded sample of
labelled documents, whose lines all carry their document's label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.encoder import slices
from ticketlens.llm.rows import documents

#: At most so many labelled documents are learned from; the driver holds their features only.
TRAIN_DOCUMENTS = 3_000
#: Of a training document at most so many lines, evenly spread, so that the sample's size is bounded.
TRAIN_LINES = 200
STEPS = 150
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>", "bang": b"!", "stop": b".", "comma": b",;:?", "other": b"\"'()[]{}+-/=@\\^_`~"}
BINS = (0.0, 0.03, 0.12, 0.3)


def _class_table() -> np.ndarray:
    table = np.zeros(256, np.int64)
    for k, chars in enumerate(CLASSES.values(), 1):
        table[list(chars)] = k
    table[[9, 10, 11, 12, 13, 32]] = len(CLASSES) + 1
    table[128:192] = len(CLASSES) + 2  # inside a character
    return table


_TABLE = _class_table()
N_CLASSES = len(CLASSES) + 3


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, characters of each line, number of lines of each text).

    Lines without a word are left out; a text without any, null or empty, is one empty line.
    """
    chunks, counts, shapes = [], [], []
    for text in texts.to_pylist():
        lines = [x for x in (text or "").encode().split(b"\n") if not x.isspace() and x] or [b""]
        seen: dict[bytes, int] = {}
        for x in lines:
            seen[x] = seen.get(x, 0) + 1
        chunks.extend(lines)
        counts.append(len(lines))
        shapes.extend((seen[x] > 1, x[-1:] in b".!?" and x != b"", len(x)) for x in lines)
    counts = np.array(counts, np.int64)
    shapes = np.array(shapes, np.float64).reshape(-1, 3)
    data = np.frombuffer(b"\n".join(chunks) + b"\n", np.uint8)
    sizes = shapes[:, 2].astype(np.int64) + 1
    kind = _TABLE[data]
    at = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * N_CLASSES + kind, minlength=len(sizes) * N_CLASSES).reshape(-1, N_CLASSES)
    space = kind == len(CLASSES) + 1
    starts = np.cumsum(sizes) - sizes
    begins = ~space & np.concatenate([[True], space[:-1]])
    words = np.add.reduceat(begins.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    chars = sizes - 1 - at[:, -1]
    shares = at[:, 1 : len(CLASSES) + 1] / np.maximum(chars - at[:, -2] + 1, 1)[:, None]
    own = np.column_stack([np.log1p(chars) / 5, np.log1p(words) / 4, chars / np.maximum(words, 1) / 8, shapes[:, 0], shapes[:, 1], shares, *[shares > b for b in BINS]])
    # the lines before and after, zero at the ends of a text
    first = np.zeros(len(sizes), bool)
    first[np.cumsum(counts) - counts] = True
    last = np.zeros(len(sizes), bool)
    last[np.cumsum(counts) - 1] = True
    before = np.where(first[:, None], 0, np.roll(own, 1, axis=0))
    after = np.where(last[:, None], 0, np.roll(own, -1, axis=0))
    return np.column_stack([np.ones(len(sizes)), own, before + after]), chars, counts


def _padded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each line in a (text, line) grid, and which cells are lines."""
    width = int(counts.max()) if len(counts) else 0
    there = np.arange(width)[None, :] < counts[:, None]
    return np.flatnonzero(there.ravel()), there


@dataclass
class Chain:
    """Weights: ``line`` favours good over bad by features, ``link`` favours two labels in a row."""

    line: np.ndarray
    link: np.ndarray

    def _scores(self, features: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells, there = _padded(counts)
        grid = np.zeros(there.shape)
        grid.ravel()[cells] = features @ self.line
        return np.stack([-grid / 2, grid / 2], 2), there

    def _passes(self, unary: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log forward and backward values, and log Z of each text."""
        n, width, _ = unary.shape
        forward, backward = np.zeros_like(unary), np.zeros_like(unary)
        forward[:, 0] = unary[:, 0]
        for t in range(1, width):
            step = np.logaddexp(forward[:, t - 1, 0, None] + self.link[0], forward[:, t - 1, 1, None] + self.link[1]) + unary[:, t]
            forward[:, t] = np.where(there[:, t, None], step, forward[:, t - 1])
        for t in range(width - 2, -1, -1):
            ahead = backward[:, t + 1] + unary[:, t + 1]
            step = np.logaddexp(ahead[:, 0, None] + self.link[:, 0], ahead[:, 1, None] + self.link[:, 1])
            backward[:, t] = np.where(there[:, t + 1, None], step, 0)
        return forward, backward, np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])

    def good(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The marginal chance of each line to be good."""
        unary, there = self._scores(features, counts)
        forward, backward, total = self._passes(unary, there)
        return np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])[there]

    def gradient(self, features: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the log-likelihood when all lines of a text have its label."""
        unary, there = self._scores(features, counts)
        forward, backward, total = self._passes(unary, there)
        chance = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])[there]
        weight = np.repeat(1 / counts, counts)
        line = ((np.repeat(labels, counts) - chance) * weight) @ features
        link = np.zeros((2, 2))
        pair = there[:, 1:]
        share = np.broadcast_to((1 / counts)[:, None], pair.shape)[pair]
        for a in range(2):
            for b in range(2):
                both = np.exp(forward[:, :-1, a] + self.link[a, b] + unary[:, 1:, b] + backward[:, 1:, b] - total[:, None])[pair]
                gold = np.broadcast_to(((labels == a) & (a == b))[:, None], pair.shape)[pair]
                link[a, b] = ((gold - both) * share).sum()
        return line, link


def train(features: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int = STEPS, rate: float = 0.05, ridge: float = 1e-3) -> Chain:
    """Adam on the mean likelihood, classes balanced by nothing but their own numbers."""
    model = Chain(np.zeros(features.shape[1]), np.zeros((2, 2)))
    if not len(counts):
        return model
    order = np.argsort(counts, kind="stable")
    ends = np.cumsum(counts)
    groups = []  # texts of about the same length together, so that the grids are full
    for part in np.array_split(order, max(1, len(order) // 250)):
        rows = np.concatenate([np.arange(ends[i] - counts[i], ends[i]) for i in part])
        groups.append((features[rows], counts[part], labels[part]))
    moment, spread = np.zeros(features.shape[1] + 4), np.zeros(features.shape[1] + 4)
    for step in range(1, steps + 1):
        parts = [model.gradient(*g) for g in groups]
        line, link = sum(p[0] for p in parts) / len(counts), sum(p[1] for p in parts) / len(counts)
        now = np.concatenate([line - ridge * model.line, (link - ridge * model.link).ravel()])
        moment, spread = 0.9 * moment + 0.1 * now, 0.999 * spread + 0.001 * now * now
        change = rate * (moment / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
        model = Chain(model.line + change[:-4], model.link + change[-4:].reshape(2, 2))
    return model


def scores(model: Chain, texts: pa.Array, cells: int = 200_000) -> np.ndarray:
    """Length-weighted mean chance of each text's lines; grids of about ``cells`` cells at a time."""
    features, chars, counts = line_features(texts)
    ends, order = np.cumsum(counts), np.argsort(counts, kind="stable")
    good = np.zeros(len(features))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * counts[order[stop]] <= cells:
            stop += 1
        part = order[at:stop]
        rows = np.concatenate([np.arange(ends[i] - counts[i], ends[i]) for i in part])
        good[rows] = model.good(features[rows], counts[part])
        at = stop
    weight = np.maximum(chars, 1).astype(np.float64)
    starts = ends - counts
    return np.clip(np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts), 0, 1) if len(starts) else good


def _sampled_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        features, _, counts = line_features(batch.column("text"))
        ends, rows = np.cumsum(counts), []
        for i, n in enumerate(counts.tolist()):
            picked = np.arange(ends[i] - n, ends[i]) if n <= TRAIN_LINES else ends[i] - n + np.linspace(0, n - 1, TRAIN_LINES).astype(np.int64)
            rows.append(features[picked].astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.binary())], ["label", "features"])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS) -> Chain:
    """Learns from at most ``most`` labelled documents that are not held out, picked by a hash of doc_id."""
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text").mapInArrow(_sampled_features, "label int, features binary").collect()
    width = line_features(pa.array([""]))[0].shape[1]
    parts = [np.frombuffer(r.features, np.float32).reshape(-1, width) for r in rows]
    order = sorted(range(len(parts)), key=lambda i: (rows[i].label, bytes(rows[i].features)))  # rows come in any order
    features = np.concatenate([parts[i] for i in order]).astype(np.float64) if parts else np.zeros((0, width))
    return train(features, np.array([len(parts[i]) for i in order], np.int64), np.array([rows[i].label for i in order], np.int64))


def scored(docs: DataFrame, model: Chain) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text); only the text counts.

    Null and empty texts are scored as one empty line; a null doc_id is not held out; repeated rows
    get equal scores; other columns are ignored. Without any label every score is 0.5.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(scores(model, part.column("text")))], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
