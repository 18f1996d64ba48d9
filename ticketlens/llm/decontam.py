"""Benchmark decontamination: passages within an edit distance of a benchmark item.

Words (lower case, letters and digits only) are the symbols. Windows as long as an item are
embedded by the CGK random walk, which turns edit distance into Hamming distance: at each step
the current symbol is written out and a random bit of (step, symbol) says whether to move on.
Two strings under few edits soon walk in step again. A repetition samples a few steps of its walk; windows and
items with equal samples are candidates, and an exact edit distance decides. Before
that, one filter that loses nothing: k edits leave one of k + 1 pieces of the item whole, so only
windows around such a piece are embedded.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.encoder import MAX_CACHED, giving_back, slices
from ticketlens.llm.rows import documents

SIMILARITY = 0.8
REPETITIONS = 48
SAMPLED = 3
#: Steps are sampled from the first WALKED times a window's words; a walk takes about twice its words to end.
WALKED, FARTHEST = 1.6, 320
#: Of items of GRID words or more only every (words / GRID)-th window is embedded, of very long ones every WIDEST-th.
GRID, WIDEST = 60, 6
EMBEDDED = 20_000
MAX_ITEM_BYTES = 32_000_000
_NOT_WORD = re.compile(r"[\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def plain(word: str) -> str:
    return _NOT_WORD.sub("", word.lower())


def split(texts: pa.Array) -> pa.Array:
    """The words of each text and item: runs of characters other than Unicode white space. Null: none."""
    return pc.utf8_split_whitespace(texts.fill_null(""))


def edits_allowed(n_words: int, similarity: float) -> int:
    return int((1 - similarity) * n_words + 1e-9)


def edit_distance(a: list[int], b: list[int]) -> int:
    """Levenshtein distance of two symbol lists, a column at a time in the bits of one integer."""
    if not a:
        return len(b)
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for y in b:
        match = where.get(y, 0)
        zero = ((((match & up) + up) ^ up) | match | down) & full
        rise, fall = (down | ~(zero | up)) & full, up & zero
        score += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1 | 1) & full, (fall << 1) & full
        up, down = (fall | ~(zero | rise)) & full, rise & zero
    return score


@dataclass
class Items:
    """Benchmark items ready to be searched for; bounded by ``MAX_ITEM_BYTES`` of text."""

    ids: list[int]
    words: list[list[str]]
    similarity: float = SIMILARITY
    repetitions: int = REPETITIONS
    seed: int = 11
    vocabulary: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for item in self.words for w in item}))}
        self.symbols = [[self.vocabulary[w] for w in item] for item in self.words]
        self.allowed = [edits_allowed(len(x), self.similarity) for x in self.symbols]
        longest = max(map(len, self.symbols), default=0)
        rng = np.random.default_rng(self.seed)
        self.walk = rng.integers(0, 1 << 63, (min(int(WALKED * longest), FARTHEST) + 2, self.repetitions), np.uint64) * np.uint64(2) + np.uint64(1)
        # the steps that a repetition samples, as shares of the walk, so that they fit every length
        self.shares = rng.random((SAMPLED, self.repetitions))
        # pieces of which one survives: the first words of each, by how many words are looked at
        self.pieces: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for t, x in enumerate(self.symbols):
            n = self.allowed[t] + 1
            for p in range(n):
                a, b = p * len(x) // n, (p + 1) * len(x) // n
                gram = x[a : min(b, a + 3)]
                self.pieces.setdefault(len(gram), {}).setdefault(int(grams(np.array(gram, np.uint64), len(gram))[0]), []).append((t, a))
        self.tables = {}
        for n, found in self.pieces.items():
            keys = np.array(sorted(found), np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[keys >> np.uint64(44)] = True
            self.tables[n] = (seen, keys)
        self.sizes = np.array([len(x) for x in self.symbols], np.int64)
        flat = np.concatenate([np.array(x, np.uint64) for x in self.symbols]) if self.symbols else np.zeros(0, np.uint64)
        self.item_marks = self.embed(flat, np.cumsum(self.sizes) - self.sizes, self.sizes, self.sizes)

    def embed(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, there: np.ndarray) -> np.ndarray:
        """A hash of the sampled steps for each window (row) and repetition (column).

        ``sizes`` are the windows' lengths, ``there`` how much of them lies inside the text. Half of the
        repetitions walk from the window's end backwards. Steps are sampled from the part of the walk in
        which a window of this length has hardly ended, and at most from the first FARTHEST steps, since
        walks of strings with many edits drift apart with their length.
        """
        n, reps = len(starts), self.repetitions
        out = np.zeros((n, reps), np.uint64)
        if not n:
            return out
        at = np.zeros((n, reps), np.int64)
        out += sizes[:, None].astype(np.uint64) * _MIX + np.arange(reps, dtype=np.uint64)[None, :]
        reach = np.clip((WALKED * sizes).astype(np.int64), 1, FARTHEST)[:, None]
        back = (np.arange(reps) % 2 == 1)[None, :]
        begin, turn = np.where(back, (starts + there - 1)[:, None], starts[:, None]), np.where(back, -1, 1)
        picked = [(self.shares[m][None, :] * reach).astype(np.int64) for m in range(SAMPLED)]
        for step in range(int(np.maximum.reduce(picked).max()) + 1):
            inside = at < there[:, None]
            now = np.where(inside, symbols[begin + turn * np.minimum(at, there[:, None] - 1)], np.uint64(1 << 40))
            for m in range(SAMPLED):
                taken = picked[m] == step
                if taken.any():
                    out = np.where(taken, (out ^ (now + np.uint64((m + 1) * int(_MIX) % (1 << 64)))) * np.uint64(0xBF58476D1CE4E5B9), out)
            at += (((now + np.uint64(1)) * self.walk[step][None, :]) >> np.uint64(63)).astype(np.int64)
        return out

    def _near(self, symbols: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, first, last) starts of the runs of windows around a surviving piece, run by run, not overlapping."""
        found: dict[int, list[tuple[int, int]]] = {}
        for n, (seen, keys) in self.tables.items():
            got = grams(symbols, n)
            for p in np.flatnonzero(seen[got >> np.uint64(44)]).tolist():
                for t, a in self.pieces[n].get(int(got[p]), ()):
                    found.setdefault(t, []).append((p, a))
        for t, hits in found.items():
            p, a = np.array(hits, np.int64).T
            text = np.searchsorted(ends, p, "right")
            low, high = np.maximum(p - a - self.allowed[t], np.where(text > 0, ends[text - 1], 0)), np.minimum(p - a + self.allowed[t], ends[text] - 1)
            good = low <= high
            order = np.lexsort((high[good], low[good]))
            low, high, text = low[good][order], np.maximum.accumulate(high[good][order]), text[good][order]
            first = np.ones(len(low), bool)  # a run ends where the next begins beyond it, or in another text
            first[1:] = (low[1:] > high[:-1] + 1) | (text[1:] != text[:-1])
            if len(low):
                yield t, low[first], high[np.append(np.flatnonzero(first)[1:] - 1, len(low) - 1)]

    def possible(self, t: int, symbols: np.ndarray, low: np.ndarray, high: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Starts, of runs from low to high, of windows with enough of an item's words: every word that is missing costs an edit.

        Words are counted by running sums over each run, so cost and memory follow the runs' length.
        """
        own, size = np.zeros(len(self.vocabulary) + 2, bool), len(self.symbols[t])
        own[self.symbols[t]] = True
        spans = high - low + 1 + size
        begins = np.cumsum(spans) - spans
        place = np.repeat(low - begins, spans) + np.arange(int(spans.sum()))
        stop = np.repeat(ends[np.searchsorted(ends, low, "right")], spans)
        sums = np.concatenate([[0], np.cumsum(own[symbols[np.minimum(place, len(symbols) - 1)]] & (place < stop), dtype=np.int64)])
        is_start = place < np.repeat(high + 1, spans)
        at = np.flatnonzero(is_start)
        return place[at[sums[at + size] - sums[at] >= size - self.allowed[t]]]

    def search(self, symbols: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, start, distance) of windows within their item's distance; of overlapping ones the closest, then the first.

        ``symbols`` holds several texts in a row, which end at ``ends``. Of long items one window
        of a few is embedded; the exact search covers all starts within the allowed edits of a candidate.
        """
        starts: dict[int, np.ndarray] = {}
        picked, items = [], []
        for t, low, high in self._near(symbols, ends):
            at = self.possible(t, symbols, low, high, ends)
            if not len(at):
                continue
            starts[t], step = at, min(max(1, len(self.symbols[t]) // GRID), WIDEST)
            shown = at[np.concatenate([[True], (at[1:] // step != at[:-1] // step) | (at[1:] > at[:-1] + step)])] if step > 1 else at
            picked.append(shown)
            items.append(np.full(len(shown), t))
        if not picked:
            return []
        at, item = np.concatenate(picked), np.concatenate(items)
        sizes = self.sizes[item]
        order = np.lexsort((at, item, sizes))  # windows of one length walk together
        at, item, sizes = at[order], item[order], sizes[order]
        there = np.minimum(sizes, ends[np.searchsorted(ends, at, "right")] - at)
        near = np.zeros(len(at), bool)
        for part in range(0, len(at), EMBEDDED):
            cut = slice(part, part + EMBEDDED)
            near[cut] = (self.embed(symbols, at[cut], sizes[cut], there[cut]) == self.item_marks[item[cut]]).any(1)
        found, at, item = [], at[near], item[near]
        for t in np.unique(item).tolist():
            mine, size, some = np.sort(at[item == t]), len(self.symbols[t]), starts[t]
            beside = np.searchsorted(mine, some)
            away = np.minimum(np.abs(some - mine[np.minimum(beside, len(mine) - 1)]), np.abs(some - mine[np.maximum(beside - 1, 0)]))
            some = some[away <= max(self.allowed[t], WIDEST)]
            text = np.searchsorted(ends, some, "right")
            words = symbols[int(some[0]) : int(some[-1]) + size].tolist() if len(some) * size > some[-1] - some[0] + size else None
            for one in np.unique(text).tolist():
                stop = int(ends[one])

                def distance(s: int, t=t, size=size, stop=stop, words=words, first=int(some[0])) -> int:
                    last = min(s + size, stop)
                    return edit_distance(self.symbols[t], words[s - first : last - first] if words is not None else symbols[s:last].tolist())

                found += [(one, t, s, d) for s, d in closest(some[text == one].tolist(), distance, self.allowed[t], size)]
        return sorted(found)


def closest(starts: list[int], distance: Callable[[int], int], most: int, size: int) -> list[tuple[int, int]]:
    """(start, distance) within ``most``: again and again the closest, then first, that keeps ``size`` away from those before.

    Best first: a shift by one word changes a window's distance by 2 at most, so the ends of a stretch of
    starts bound what lies between them, and a stretch is looked into only if that could be next.
    """
    known: dict[int, int] = {}
    taken: list[int] = []
    heap: list[tuple[int, int, int, int]] = []

    def clear(low: int, high: int) -> bool:
        """Whether some start from low to high keeps away from those taken."""
        i = bisect.bisect_right(taken, low)
        if i and low - taken[i - 1] < size:
            low = taken[i - 1] + size
        if i < len(taken) and taken[i] - high < size:
            high = taken[i] - size
        return low <= high

    def value(i: int) -> int:
        if i not in known:
            known[i] = distance(starts[i])
            heapq.heappush(heap, (known[i], starts[i], i, i))
        return known[i]

    def stretch(i: int, j: int) -> None:
        if j - i > 1:
            least = max(0, -(-(value(i) + value(j) - 2 * (starts[j] - starts[i])) // 2))
            if least <= most:
                heapq.heappush(heap, (least, starts[i], i, j))

    if starts:
        value(0)
        value(len(starts) - 1)
        stretch(0, len(starts) - 1)
    out = []
    while heap:
        d, s, i, j = heapq.heappop(heap)
        if d > most:
            break
        if i == j:
            if clear(s, s):
                bisect.insort(taken, s)
                out.append((s, d))
        elif clear(starts[i + 1], starts[j - 1]):
            k = (i + j) // 2
            value(k)
            stretch(i, k)
            stretch(k, j)
    return out


def grams(symbols: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of n symbols; 0, which no item has, for runs with unknown words."""
    if len(symbols) < n or n == 0:
        return np.zeros(0, np.uint64)
    m = len(symbols) - n + 1
    out, known = np.zeros(m, np.uint64), np.ones(m, bool)
    for i in range(n):
        x = symbols[i : i + m]
        out = (out + x) * _MIX
        out ^= out >> np.uint64(29)
        known &= x > 0
    return np.where(known, out | np.uint64(1), np.uint64(0))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("distance", pa.int64())])


def _searcher(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        known = items.vocabulary.get
        for batch in batches:
            for part in slices(batch):
                lists = split(part.column("text"))
                coded = lists.values.dictionary_encode()
                if len(cache) > MAX_CACHED:
                    cache.clear()
                each = []
                for w in coded.dictionary.to_pylist():
                    if (i := cache.get(w)) is None:
                        p = plain(w)
                        i = cache[w] = known(p, 0) if p else -1
                    each.append(i)
                ids = np.array(each, np.int64)[coded.indices.to_numpy()] if each else np.zeros(0, np.int64)
                keep = np.flatnonzero(ids >= 0)
                edges = lists.offsets.to_numpy().astype(np.int64)
                ends = np.searchsorted(keep, edges[1:])
                found = items.search(ids[keep].astype(np.uint64), ends)
                if not found:
                    continue
                docs = part.column("doc_id").cast(pa.int64()).to_pylist()
                rows = []
                for text, item, start, d in found:
                    stop = min(start + len(items.symbols[item]), int(ends[text])) - 1
                    first = int(keep[start]) - int(edges[text])
                    rows.append({"doc_id": docs[text], "item_id": items.ids[item], "start_word": first, "n_words": int(keep[stop]) - int(edges[text]) - first + 1, "distance": d})
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return run


def _item_blocks(benchmark: DataFrame, similarity: float, most: int) -> Iterator[Items]:
    """The items in blocks of about ``most`` bytes; a block is what the driver and a task hold at once."""
    picked = benchmark.select(F.col("item_id").cast("long"), "text").filter("text IS NOT NULL")
    total = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // most)
    for b in range(blocks):
        rows = picked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        rows.sort(key=lambda r: (r.item_id is None, r.item_id, r.text))
        lists = split(pa.array([r.text for r in rows], pa.string())).to_pylist()
        found = [(r.item_id, [p for w in words if (p := plain(w))]) for r, words in zip(rows, lists, strict=True)]
        found = [x for x in found if x[1]]
        if found:
            yield Items([x[0] for x in found], [x[1] for x in found], similarity)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, most: int = MAX_ITEM_BYTES) -> DataFrame:
    """doc_id, item_id, start_word, n_words, distance of every passage close to a benchmark item.

    A passage is a window of as many words as the item, at an edit distance over words of at most
    (1 - ``similarity``) times the item's words. Case and marks do not count, nor do words of
    marks alone. Of overlapping passages of one item the closest is returned. Whole
    texts are searched for all items, however long the texts are; items beyond ``most`` bytes
    are searched for in further passes. Null or empty texts hold and are nothing; a null doc_id
    or item_id stays null; repeated rows give repeated matches; other columns are ignored.
    """
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start_word long, n_words long, distance long")
    for items in _item_blocks(benchmark, similarity, most):
        out = out.union(docs.select("doc_id", "text").mapInArrow(giving_back(_searcher(items)), out.schema))
    return out


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, most: int = MAX_ITEM_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no passage that ``contaminated`` finds; one pass, no shuffle."""
    for items in _item_blocks(benchmark, similarity, most):
        find = _searcher(items)

        def run(batches: Iterator[pa.RecordBatch], find=find) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    numbered = pa.RecordBatch.from_arrays([pa.array(range(part.num_rows), pa.int64()), part.column("text")], ["doc_id", "text"])
                    hit = {d for found in find(iter([numbered])) for d in found.column("doc_id").to_pylist()}
                    yield part.filter(pa.array([i not in hit for i in range(part.num_rows)])) if hit else part

        docs = docs.mapInArrow(giving_back(run), docs.schema)
    return docs
