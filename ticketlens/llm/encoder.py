"""Token ids of whole texts, a vocabulary file's own way, at the price of its distinct words.

Where a tokenizer drops white space and never merges across it, a text's ids are its words' ids in
a row. Arrow finds the distinct words of a slice of texts; each is encoded once for a worker. Each vocabulary
file is first tried on probe texts; one that does not work this way has its texts encoded whole.
"""

from __future__ import annotations

import ctypes
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters that are one character in either case and in normal form C, then plain marks. No quote: it joins with letters ('s).
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")
MAX_CACHED = 400_000
#: Words whose ids an encoder keeps; over check_s a worker peaks at 220 MB with them, at 282 MB with MAX_CACHED.
MAX_CODED = 150_000
SLICE_BYTES = 4_000_000
#: Texts on which the short cuts must give the library's own ids.
PROBES = (
    "The quick brown Fox, (it) jumped: over 12 lazy dogs' backs!", "  two  spaces\tand\n\nlines \n", "ÉCOLE d'été naïve Straße ÑANDÚ İstanbul ǅ ﬁ", "don't can't HTML's we'll", "3.14 1,000 2024-01-02 a_b x@y.z #tag $5 50%",
    "日本語 テスト 한국어 привет мир שלום", "e\u0301 a\u030a \u00a0nbsp\u3000wide", "\U0001f600 ok\u200d\U0001f525 …“quoted”—dash", "", " ", "x", "</s> <s> [UNK] <unk> <pad> <|endoftext|> [CLS] a[SEP]b", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa ZZZZZZ", "ein, zwei; drei. (vier) [fünf] {sechs}",
)


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable ones as themselves, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in shown)
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + n) for n, b in enumerate(hidden)}}


class Encoder:
    """Encodes Arrow arrays of texts with a file of the tokenizers library, with the ids that the library gives each whole text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._model = self._whole.model
        self._letters = _byte_letters()
        # ids as bytes of unsigned 32-bit numbers, a fraction of what tuples of numbers take
        self._words: dict[str, bytes] = {}
        self._parts: dict[str, bytes] = {}
        self.vocabulary = self._whole.get_vocab_size(with_added_tokens=True)
        # by words with a short cut for plain ones, by words, or whole
        self._plain, self._by_word = True, True
        if not self._right():
            self._plain = False
            self._words.clear()
            self._by_word = self._right()
        self._words.clear()

    def _right(self) -> bool:
        """Whether the short cuts give the library's ids on all probes."""
        try:
            ids, counts = self.encode(pa.array(PROBES))
        except KeyError:
            return False
        want = [self._whole.encode(t, add_special_tokens=False).ids for t in PROBES]
        return counts.tolist() == list(map(len, want)) and ids.tolist() == list(chain.from_iterable(want))

    def _part(self, part: str) -> bytes:
        if (found := self._parts.get(part)) is None:
            shown = part if part.isascii() else "".join(map(self._letters.__getitem__, part.encode()))
            found = self._parts[part] = array("I", [t.id for t in self._model.tokenize(shown)]).tobytes()
        return found

    def word(self, word: str) -> bytes:
        """Ids of a text without white space, as unsigned 32-bit numbers."""
        if (found := self._words.get(word)) is None:
            if self._plain and (m := _PLAIN.match(word)):
                found = self._part(m[1].lower()) + (self._part(m[2]) if m[2] else b"")
            else:
                found = array("I", self._whole.encode(word, add_special_tokens=False).ids).tobytes()
            self._words[word] = found
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text); null is an empty text."""
        if not self._by_word:
            each = [e.ids for e in self._whole.encode_batch(texts.fill_null("").to_pylist(), add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(each), np.uint32), np.array(list(map(len, each)), np.int64)
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.dictionary_encode()
        index = coded.indices.to_numpy()
        if len(self._words) > MAX_CODED:
            self._words.clear()
            self._parts.clear()
        each = [self.word(w) for w in coded.dictionary.to_pylist()]
        lengths = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), np.uint32)
        starts = np.cumsum(lengths) - lengths
        ends = np.concatenate([[0], np.cumsum(lengths[index])])
        at = np.repeat(starts[index] - ends[:-1], lengths[index]) + np.arange(ends[-1])
        return flat[at], ends[offsets[1:]] - ends[offsets[:-1]]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def give_back() -> None:
    """Hands memory that a task has freed back to the system: workers stay for other tasks, and what they keep adds to their executor's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the C library of most Linux systems keeps it else
        trim(0)


def giving_back(run: Callable) -> Callable:
    """A task that hands back its memory when its last batch is done."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidy


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, or one row."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    cut = np.flatnonzero(np.diff(np.cumsum(sizes) // most, prepend=0) > 0)
    edges = [0, *cut.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
