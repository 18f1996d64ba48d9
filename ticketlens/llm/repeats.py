"""Repeated passages, from suffix trees partitioned by prefixes of variable length.

A repeat of 20 words is an internal node of the tree of all suffixes, at a depth of 20 words or more. The
tree is built in parts that fit a task, and only where it branches:

1. *Sampling.* Of the 6-word prefixes inside a 20-word window the one with the least hash
   stands for the window, so equal windows share it, and only about one suffix in seven is listed. A prefix
   that occurs once leads to leaves only; its windows are dropped.
2. *Edges.* The windows in a row that one prefix stands for are a run of up to 34 words. Equal runs are one
   edge of the tree: all but the first are repeats as a whole. A prefix with one edge branches no further.
3. *Groups.* Edges of one prefix, with their words, are one group. A group of more than GROUP_EDGES is
   split by a longer prefix (10, 14, 18 words, each again the one of least hash), until it fits a task's memory.
   What is left at the window's length is equal windows, which need no tree.
4. *Subtrees.* A task sorts the suffixes of its groups word by word and takes the lengths that neighbours
   share, which are the depths of the internal nodes. The leaves below a node at a window's depth
   are one repeat; all but the first are marked.

A document's repeated windows in a row are one maximal repeat. Words are told by 64-bit hashes, edges by
64 bits of hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.encoder import MAX_CACHED, slices
from ticketlens.llm.rows import documents, keyed
from ticketlens.plans.shared import checkpoint, small_batches, spread_join, stored

WINDOW = 20
PREFIX = 6
#: A group of up to so many edges (below 34 words each) is one task's at once; larger ones get LONGER prefixes.
GROUP_EDGES = 16_384
LONGER = 4
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Hasher:
    """A 64-bit hash of each word of a slice of texts."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words in a row, offset of each text and the end)."""
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        flat, edges = lists.values, lists.offsets.to_numpy().astype(np.int64)
        filled = np.asarray(pc.not_equal(flat, "")) if len(flat) else np.zeros(0, bool)
        if not filled.all():
            flat, edges = flat.filter(pa.array(filled)), np.concatenate([[0], np.cumsum(filled)])[edges]
        coded = flat.dictionary_encode()
        if len(self.known) > MAX_CACHED:
            self.known.clear()
        each = []
        for w in coded.dictionary.to_pylist():
            if (h := self.known.get(w)) is None:
                h = self.known[w] = xxhash.xxh3_64_intdigest(w.encode())
            each.append(h)
        return np.array(each, np.uint64)[coded.indices.to_numpy()], edges


def _join(a: np.ndarray, b: np.ndarray, by: np.uint64) -> np.ndarray:
    n = min(len(a), len(b))
    out = (a[:n] * by) ^ (b[:n] + _B)
    out ^= out >> np.uint64(32)
    out *= _A
    out ^= out >> np.uint64(29)
    return out


def runs_of(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n words in a row."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    parts, size, at, out = words, 1, 0, None
    while True:  # by the binary digits of n: hashes of 1, 2, 4, ... words, put together
        if n & 1:
            out = parts if out is None else _join(out, parts[at:], _B)
            at += size
        n >>= 1
        if not n:
            return out
        parts, size = _join(parts, parts[size:], _A), size * 2


def least_prefix(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` prefixes the least of their hashes."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    out, size = hashes, 1
    while size * 2 <= width:
        out, size = np.minimum(out[:-size], out[size:]), size * 2
    return np.minimum(out[: len(out) - (width - size)], out[width - size :])


def _windows(edges: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of every window that lies in one text."""
    counts = np.maximum(np.diff(edges) - window + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + edges[:-1][text]
    return text, first


def cut_runs(words: np.ndarray, edges: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, number of windows, prefix) of the runs of windows that one place of a prefix stands for."""
    text, first = _windows(edges, window)
    if not len(text):
        return text, first, first, np.zeros(0, np.uint64)
    hashes = runs_of(words, prefix)
    marks = least_prefix(hashes, window - prefix + 1)[first]
    # the same place stands for the next window too, unless it starts the one before
    gone = hashes[first[:-1]] == marks[:-1]
    new = np.flatnonzero(np.concatenate([[True], gone | (marks[1:] != marks[:-1]) | (text[1:] != text[:-1])]))
    return text[new], first[new], np.append(new[1:], len(marks)) - new, marks[new]


def _prefixes(window: int, prefix: int, only: bool = False):
    """prefix, run, _rid, first, n of every run; or the prefix only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for part in slices(batch):
                words, edges = hasher.words(part.column("text"))
                text, first, n, marks = cut_runs(words, edges, window, prefix)
                if not len(text):
                    continue
                if only:
                    yield pa.RecordBatch.from_arrays([pa.array(marks.view(np.int64))], ["prefix"])
                    continue
                whole = runs_of(words, window)
                # its first and last window cover a run, which is shorter than two windows
                runs = _join(whole[first], whole[first + n - 1] + n.astype(np.uint64), _A)
                rid = part.column("_rid").to_numpy()[text]
                yield pa.RecordBatch.from_arrays([pa.array(marks.view(np.int64)), pa.array(runs.view(np.int64)), pa.array(rid), pa.array((first - edges[text]).astype(np.int32)), pa.array(n.astype(np.int32))], ["prefix", "run", "_rid", "first", "n"])

    return run


_EDGES = "key long, _rid long, first int, n int, words binary"


def _edge_rows(key: np.ndarray, rid: np.ndarray, first: np.ndarray, n: np.ndarray, words: np.ndarray, at: np.ndarray, window: int) -> pa.RecordBatch:
    """Edges with their words, which begin at ``at``."""
    raw, width = words.tobytes(), words.itemsize
    held = [raw[a * width : (a + k + window - 1) * width] for a, k in zip(at.tolist(), n.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rid), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(held, pa.binary())], ["key", "_rid", "first", "n", "words"])


def _edges(window: int, prefix: int):
    """The listed runs (``spans``) of each text as edges with their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for part in slices(batch):
                words, edges = hasher.words(part.column("text"))
                spans = part.column("spans")
                text = np.repeat(np.arange(part.num_rows), np.diff(spans.offsets.to_numpy()))
                marks = spans.flatten().to_numpy()
                first, n = marks >> 8, (marks & 255) >> 2
                at = edges[:-1][text] + first
                least = least_prefix(runs_of(words, prefix), window - prefix + 1)
                yield _edge_rows(least[at], part.column("_rid").to_numpy()[text], first, n, words, at, window)

    return run


def _lengthened(window: int, prefix: int):
    """The same windows under longer prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("words")
            sizes = pc.binary_length(held).to_numpy().astype(np.int64) // 8
            words = np.frombuffer(b"".join(held.to_pylist()), np.uint64)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            row, at, n, marks = cut_runs(words, edges, window, prefix)
            if len(row):
                key = _join(batch.column("key").to_numpy().view(np.uint64)[row], marks, _A)
                yield _edge_rows(key, batch.column("_rid").to_numpy()[row], batch.column("first").to_numpy()[row] + (at - edges[row]), n, words, at, window)

    return run


def shared_lengths(key: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, length shared with the one before) of suffixes (a row of words each), sorted word by word inside each key.

    The lengths are the depths of the internal nodes of each key's suffix tree; 0 where a key begins.
    """
    order = np.lexsort((*suffixes.T[::-1], key))
    a, b = suffixes[order[1:]], suffixes[order[:-1]]
    same = a == b
    depth = np.where(same.all(1), suffixes.shape[1], same.argmin(1))
    return order, np.concatenate([[0], np.where(key[order[1:]] == key[order[:-1]], depth, 0)])


def _again(part: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """_rid, at of the leaves below nodes of a window's depth, but the first of each; ``part`` has whole groups."""
    held, n = part.column("words"), part.column("n").to_numpy().astype(np.int64)
    sizes = pc.binary_length(held).to_numpy().astype(np.int64) // 8
    words = np.frombuffer(b"".join(held.to_pylist()), np.uint64)
    begin = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    suffixes = words[(begin[row] + place)[:, None] + np.arange(window)[None, :]]
    rid, at = part.column("_rid").to_numpy()[row], part.column("first").to_numpy()[row] + place
    order, depth = shared_lengths(part.column("key").to_numpy()[row], suffixes)
    node = np.cumsum(depth < window)
    rid, at = rid[order], at[order]
    # by node, the first leaf in document order, then the others
    by = np.lexsort((at, rid, node))
    later = by[np.concatenate([[False], node[by[1:]] == node[by[:-1]]])]
    return pa.RecordBatch.from_arrays([pa.array(rid[later]), pa.array(at[later].astype(np.int32))], ["_rid", "at"])


def _subtrees(window: int):
    """The leaves of repeats, from edges that come key by key; several groups are sorted at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column("key").to_numpy()
            last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if batch.num_rows and (keys != keys[-1]).any() else 0
            # all but the last key of the batch are whole; the last may go on in the next one
            if held and (last or keys[0] != held[-1].column("key")[-1].as_py()):
                first = int(np.flatnonzero(keys != held[-1].column("key")[-1].as_py())[0]) if keys[0] == held[-1].column("key")[-1].as_py() else 0
                yield _again(_one([*held, batch.slice(0, first)]), window)
                held, batch, last = [], batch.slice(first), last - first
            if last > 0:
                yield _again(batch.slice(0, last), window)
                batch = batch.slice(last)
            if batch.num_rows:
                held.append(batch)
        if held:
            yield _again(_one(held), window)

    return run


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _nodes(window: int):
    """node (a hash of its words), _rid, at of every window of edges that prefixes as long as a window cannot split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("words")
            sizes = pc.binary_length(held).to_numpy().astype(np.int64) // 8
            words = np.frombuffer(b"".join(held.to_pylist()), np.uint64)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            row, first = _windows(edges, window)
            node = runs_of(words, window)[first]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row)), pa.array(node.view(np.int64)), batch.column("_rid").take(pa.array(row)), pa.array((batch.column("first").to_numpy()[row] + first - edges[row]).astype(np.int32))], ["key", "node", "_rid", "at"])

    return run


#: A mark is one long: first window, number of windows (below 64), kind.
RUN, FIRST, CUT, WINDOW_FIRST = range(4)


def _mark(first: Column, n: Column, kind: int | Column) -> Column:
    return F.shiftleft(first.cast("long"), 8) + n.cast("long") * 4 + kind


def _spread(first: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The window numbers of spans, ascending."""
    hit = np.zeros(size + 1, np.int64)
    np.add.at(hit, first, 1)
    np.add.at(hit, np.minimum(first + n, size), -1)
    return np.flatnonzero(np.cumsum(hit)[:-1] > 0)


def _lists(column: pa.Array) -> list[np.ndarray | None]:
    """The longs of each list, without a Python object for each."""
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [None if null else values[a:b] for a, b, null in zip(offsets[:-1].tolist(), offsets[1:].tolist(), column.is_null().to_pylist(), strict=True)]


def _repeated(marks: np.ndarray, size: int) -> np.ndarray:
    """Which windows of a text also start earlier.

    Marks say: a run; a run that is the first of its like; windows that start earlier; a window that is first after all.
    """
    first, n, kind = marks >> 8, (marks & 255) >> 2, marks & 3
    out = np.zeros(size, bool)
    cut, later = kind == CUT, (kind == RUN) & ~np.isin(first, first[kind == FIRST])
    out[_spread(first[cut], n[cut], size)] = True
    out[first[kind == WINDOW_FIRST]] = False
    out[_spread(first[later], n[later], size)] = True
    return out


def _kept(window: int):
    """What is left of a text: its words but those of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, marks in zip(batch.column("text").to_pylist(), _lists(batch.column("marks")), strict=True):
                words = (text or "").encode().split()
                n, found = len(words), []
                if marks is not None:
                    at = np.flatnonzero(_repeated(marks, max(n - window + 1, 0)))
                    cover = np.zeros(n + 1, np.int64)
                    cover[at] += 1
                    cover[at + window] -= 1
                    gone = np.cumsum(cover)[:-1] > 0
                    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                    found = [{"start": int(a), "stop": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((n, sum(s["stop"] - s["start"] for s in found), found, b" ".join(words).decode()))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)]], ["doc_id", "n_words", "n_removed", "repeats", "kept_text"])

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP_EDGES) -> DataFrame:
    """doc_id, n_words, n_removed, repeats, kept_text for every row of ``docs`` (doc_id, text).

    A word is removed if a window of ``window`` words that covers it also starts earlier: in a document
    of smaller doc_id, or earlier in its own. Windows are judged on the input. ``repeats`` are
    the maximal runs of removed words (start, stop). Null texts have no words; texts shorter than a
    window stay whole; null doc_ids come first; rows with one doc_id follow one another as
    documents of their own; an empty table gives an empty one; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = keyed(docs).select("_rid", "doc_id", "text")
    first, n = F.col("first"), F.col("n")
    with small_batches(docs.sparkSession):
        counted = texts.select("_rid", "text").mapInArrow(_prefixes(window, prefix, only=True), "prefix long")
        again = checkpoint(counted.groupBy("prefix").agg(F.count("*").alias("_k")).filter("_k > 1"))
        listed = texts.select("_rid", "text").mapInArrow(_prefixes(window, prefix), "prefix long, run long, _rid long, first int, n int")
        some = stored(spread_join(listed, again.select("prefix"), "prefix", "left_semi", again))
        runs = stored(some.groupBy("prefix", "run").agg(F.min(F.struct("_rid", "first", "n")).alias("f")))
        forks = runs.groupBy("prefix").agg(F.count("*").alias("_k")).filter("_k > 1")
        cut = spread_join(runs, forks.select("prefix"), "prefix", "left_semi", forks).select("f.*")
        texts = texts.repartition("_rid")  # dealt once: both readers below take the same columns, so they share this exchange
        spans = cut.groupBy("_rid").agg(F.collect_list(_mark(first, n, CUT)).alias("spans"))
        edges = stored(texts.join(spans, "_rid").select("_rid", "doc_id", "text", "spans").mapInArrow(_edges(window, prefix), _EDGES))
        later = [m.select("_rid", _mark(F.col("at"), F.col("n"), F.col("kind")).alias("m")) for m in repeats(edges, window, prefix, group)]
    marks = some.select("_rid", _mark(first, n, RUN).alias("m")).union(runs.select("f._rid", _mark(F.col("f.first"), F.col("f.n"), FIRST)))
    for m in later:
        marks = marks.union(m)
    marked = texts.select("_rid", "doc_id", "text").join(marks.groupBy("_rid").agg(F.collect_list("m").alias("marks")), "_rid", "left")
    return marked.select("doc_id", "text", "marks").mapInArrow(_kept(window), f"doc_id {kind}, n_words long, n_removed long, repeats array<struct<start:long,stop:long>>, kept_text string")


def repeats(edges: DataFrame, window: int, prefix: int, group: int) -> list[DataFrame]:
    """(_rid, at, n, kind) marks of the windows of ``edges`` that start earlier among them.

    Groups by prefix that have more than ``group`` edges are split by longer prefixes, each length in one round over those groups only.
    """
    out = []
    one, again = F.lit(1), F.lit(CUT)
    while True:
        counts = edges.groupBy("key").agg(F.count("*").alias("_k")).filter("_k > 1")
        heavy = checkpoint(counts.filter(F.col("_k") > group).select("key"))
        some = bool(heavy.take(1))
        light = edges.join(heavy, "key", "left_anti") if some else edges
        sorted_ = light.repartition("key").sortWithinPartitions("key")
        out.append(sorted_.mapInArrow(_subtrees(window), "_rid long, at int").select("_rid", "at", one.alias("n"), again.alias("kind")))
        if not some:
            return out
        prefix = min(prefix + LONGER, window)
        edges = edges.join(heavy, "key", "left_semi").mapInArrow(_lengthened(window, prefix), _EDGES)
        if prefix == window:  # groups are equal windows: sums before they move are enough
            nodes = stored(edges.mapInArrow(_nodes(window), "key long, node long, _rid long, at int"))
            firsts = nodes.groupBy("key", "node").agg(F.min(F.struct("_rid", "at")).alias("f")).select("f.*")
            return [*out, nodes.select("_rid", "at", one.alias("n"), again.alias("kind")), firsts.select("_rid", "at", one.alias("n"), F.lit(WINDOW_FIRST).alias("kind"))]
        edges = stored(edges)


def op10_repeats(spark, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
