"""Personal data by a semi-Markov conditional random field over whole spans.

A text is cut into tokens (words, and marks one by one). A labelling is a row of segments: single
tokens outside any entity, or entities of up to ``MAX_TOKENS`` tokens with a kind. A segment is scored as a
whole (digits, groups, check sum, shape, what touches it), neighbouring labels are scored in pairs, and a
bounded dynamic program finds the best segments and kinds together. Plain patterns give the base spans, which
always stay. The model learns from a bounded sample of them, and from the same spans written in other
layouts, and adds what it finds beside them: cards among other numbers, phones without +, spelled-out at signs.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.encoder import slices
from ticketlens.llm.rows import documents

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 14
#: Starts of segments that are looked at together.
PART = 8_192
#: The model learns from pieces of WINDOW tokens, MAX_PIECE characters at most, of so many texts, so many of each, and of so many invented texts.
TRAIN_TEXTS, TRAIN_WINDOWS, MADE = 300, 2, 300
WINDOW, MARGIN, MAX_PIECE = 32, 8, 4_000
STEPS = 120
SEED = 31

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match never starts inside a run of digits: one that fails at its start fails there too.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[(\[][aA][tT][)\]]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches from each @: the local part is the run before it, the rest a domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ip_ok(part: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x[-4:] if x.lstrip("0") else "0") <= 255 for x in part.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain patterns, by start, then kind."""
    found = [(a, 0, b) for a, b in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _ip_ok(m[0])]
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found)


NAMES = (
    "bias", "digits_10_15", "digits_14_19", "luhn", "plus", "no_letters", "at", "at_domain", "four_groups", "four_bytes", "letters", "mark_before",
    "mark_after", "tokens", "digits_few", "digits_many", "wide_gap", "phone_marks", "card_marks", "blanks", "unknown_shape", "beside_digits", "named_at", "at_blanks", "four_blanks", "four_dots",
)
LETTER, DIGIT, UNDER, MARK, BLANK, BREAK = range(6)
LOW = -1e30


@lru_cache(1)
def _char_kinds() -> np.ndarray:
    """What each code point is to the tokens: letter, ASCII digit, underscore, mark, blank or line break."""
    table = np.full(0x110000, MARK, np.uint8)
    for c in range(0x110000):
        s = chr(c)
        if s.isalnum():
            table[c] = LETTER
        elif s.isspace():
            table[c] = BLANK
    table[48:58], table[95], table[[10, 13]] = DIGIT, UNDER, BREAK
    return table


class Tokens:
    """Words and marks of a text as arrays, with running sums so that a whole span's features are differences."""

    def __init__(self, text: str):
        chars = np.frombuffer(text.encode("latin-1"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _char_kinds()[chars]
        word = kind <= UNDER
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        mark = kind == MARK
        self.start = np.flatnonzero(begins | mark).astype(np.int32)
        stops = word.copy()
        stops[:-1] &= ~word[1:]
        self.end = (np.flatnonzero(stops | mark) + 1).astype(np.int32)
        n = len(self.start)
        self.is_word = word[self.start]
        size = self.end - self.start

        def count(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            sums = np.concatenate([[0], np.cumsum(which, dtype=np.int32)])
            return sums, sums[self.end] - sums[self.start]

        digit = kind == DIGIT
        digit_sums, digits = count(digit)
        _, letters = count(kind == LETTER)
        breaks, _ = count(kind == BREAK)
        # digits one by one, each as it is and as the check sum doubles it, by the parity of its place
        value = (chars[digit] - 48).astype(np.int32)
        twice = value * 2 - 9 * (value > 4)
        odd = (np.arange(len(value)) & 1).astype(bool)
        self.check = np.stack([np.concatenate([[0], np.cumsum(np.where(odd, twice, value), dtype=np.int32)]), np.concatenate([[0], np.cumsum(np.where(odd, value, twice), dtype=np.int32)])])
        self.digit_at, self.digit_to = digit_sums[self.start], digit_sums[self.end]
        first = np.where(self.is_word, 0, chars[self.start]).astype(np.int64)
        gap = np.zeros(n, np.int32)
        gap[1:] = self.start[1:] - self.end[:-1]
        self.broken = np.zeros(n, bool)  # a line ends before the token
        self.broken[1:] = breaks[self.start[1:]] > breaks[self.end[:-1]]
        self.first, self.gap = first, gap
        number = self.is_word & (digits == size)
        # as a number, up to three digits after leading zeros
        lead = np.minimum(digits, 4)
        small = np.zeros(n, np.int64)
        for k in range(3):
            has = number & (lead > k)
            small = np.where(has, small * 10 + chars[np.minimum(self.start + k, len(chars) - 1)] - 48, small)
        byte = number & (digits <= 3) & (small <= 255)
        spelled = np.zeros(n, bool)
        if n > 2:
            two = self.is_word[1:-1] & (size[1:-1] == 2) & (chars[self.start[1:-1]] | 32 == 97) & (chars[np.minimum(self.start[1:-1] + 1, len(chars) - 1)] | 32 == 116)
            spelled[1:-1] = two & np.isin(first[:-2], (40, 91)) & np.isin(first[2:], (41, 93))
        self.at, self.spelled = (first == 64) | spelled, spelled
        self.trigger = (digits > 0) | self.at
        # where the next at sign is
        places = np.where(self.at, np.arange(n), n)
        self.next_at = np.append(np.minimum.accumulate(places[::-1])[::-1], n) if n else np.zeros(1, np.int64)
        self.tail = self.is_word & (digits == 0) & (letters >= 2)
        sums = lambda which: np.concatenate([[0], np.cumsum(which, dtype=np.int32)])
        self.sums = {
            "digits": sums(digits), "letters": sums(letters), "chars": sums(size + gap), "trigger": sums(self.trigger), "at": sums(self.at), "dots": sums(first == 46), "numbers": sums(number),
            "odd": sums(number & ~byte), "marks": sums(~self.is_word), "phone": sums(np.isin(first, (43, 40, 41, 45, 46))), "card": sums(np.isin(first, (45, 46, 47))), "gaps": sums(gap > 0), "wide": sums(gap > 1), "breaks": sums(self.broken),
        }
        shown = np.where(number, np.minimum(digits, 20), np.where(self.is_word, np.where(digits == 0, 21, 22), 32 + first))
        self.code = (shown * 4 + np.minimum(gap, 2) + 1).astype(np.uint64)
        self.shown = (shown * 4 + 1).astype(np.uint64)

    def __len__(self) -> int:
        return len(self.start)

    def candidates(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, past last, shape) tokens of the segments that begin in [low, high) and may be entities.

        They hold a digit or an at sign, begin with a word, + or (, end with a word, and stay on a line.
        The shape is a hash of the kinds of tokens, lengths of numbers, marks and blanks in a row.
        """
        n = len(self)
        i = np.arange(low, high)[self.is_word[low:high] | np.isin(self.first[low:high], (43, 40))]
        near = self.sums["trigger"][np.minimum(i + MAX_TOKENS, n)] > self.sums["trigger"][i]
        i = i[near]
        shape, out = self.shown[i] * _MIX, []
        for length in range(1, MAX_TOKENS + 1):
            if length > 1:
                alive = i + length <= n
                i, shape = i[alive], shape[alive]
                last = i + length - 1
                alive = ~self.broken[last]
                i, shape = i[alive], shape[alive]
                shape = (shape ^ self.code[i + length - 1]) * _MIX
                shape ^= shape >> np.uint64(31)
            j = i + length
            good = self.is_word[j - 1] & (self.sums["trigger"][j] > self.sums["trigger"][i])
            out.append((i[good], j[good], shape[good]))
        i, j, shape = (np.concatenate([x[k] for x in out]) for k in range(3))
        order = np.lexsort((j, i))
        return i[order], j[order], shape[order]

    def features(self, i: np.ndarray, j: np.ndarray, known: np.ndarray) -> np.ndarray:
        """What each span (tokens i to j) looks like as a whole, and the marks that touch it."""
        n = len(self)
        d = {k: s[j] - s[i] for k, s in self.sums.items()}
        digits, numbers, marks = d["digits"], d["numbers"], d["marks"]
        end = self.digit_to[j - 1] if n else j
        parity = (end - 1) & 1
        total = np.where(parity == 0, self.check[0][end] - self.check[0][self.digit_at[i]], self.check[1][end] - self.check[1][self.digit_at[i]])
        valid = (total % 10 == 0) & (digits >= 14) & (digits <= 19)
        bare = d["letters"] == 0
        inside = self.sums["gaps"][j] - self.sums["gaps"][np.minimum(i + 1, j)]
        wide = self.sums["wide"][j] - self.sums["wide"][np.minimum(i + 1, j)]
        at = np.minimum(self.next_at[i], n)
        has_at = at < j
        wider = self.spelled[np.minimum(at, n - 1)].astype(np.int64)  # a bracket on both sides of a spelled-out at sign
        begin = np.minimum(at + 1 + wider, n)
        named = (at - wider > i) & self.is_word[np.maximum(np.minimum(at, n - 1) - 1 - wider, 0)]
        domain = has_at & named & (self.sums["dots"][j] > self.sums["dots"][begin]) & (self.sums["gaps"][j] <= self.sums["gaps"][np.minimum(begin + 1, j)]) & self.tail[j - 1]
        four = bare & (numbers == 4)
        before, after = np.maximum(i - 1, 0), np.minimum(j, n - 1)
        touch_before = (i > 0) & (self.gap[i] == 0) & np.isin(self.first[before], (46, 64, 43, 45, 47, 58, 61, 95))
        further = np.minimum(j + 1, n - 1)
        touch_after = (j < n) & (self.gap[after] == 0) & np.isin(self.first[after], (46, 64, 45, 47, 58)) & (j + 1 < n) & (self.gap[further] == 0) & self.is_word[further]
        beside = ((i > 0) & (self.sums["digits"][i] > self.sums["digits"][before]) & ~self.broken[i]).astype(float) + ((j < n) & (self.sums["digits"][np.minimum(j + 1, n)] > self.sums["digits"][j]))
        chars = np.maximum(self.end[j - 1] - self.start[i], 1)
        return np.column_stack([
            np.ones(len(i)), (digits >= 10) & (digits <= 15), (digits >= 14) & (digits <= 19), valid, self.first[i] == 43, bare, has_at, domain, four, four & (d["odd"] == 0), d["letters"] / chars, touch_before,
            touch_after, (j - i) / MAX_TOKENS, digits < 4, digits > 19, wide > 0, bare & (marks == d["phone"]), bare & (marks == d["card"]), inside > 0, ~known, beside, has_at & named, has_at & (self.sums["gaps"][j] > self.sums["gaps"][np.minimum(i + 1, j)]) & domain, four & (d["odd"] == 0) & (inside > 0), four & (d["dots"] == 3),
        ]).astype(np.float64)


class SpanModel:
    """Weights of span features and shapes by kind, and of neighbouring labels (0: outside)."""

    def __init__(self, weights: np.ndarray | None = None, link: np.ndarray | None = None, shapes: np.ndarray | None = None, shape_weights: np.ndarray | None = None):
        self.weights = np.zeros((len(KINDS), len(NAMES))) if weights is None else weights
        self.link = np.zeros((len(KINDS) + 1, len(KINDS) + 1)) if link is None else link
        self.shapes = np.zeros(0, np.uint64) if shapes is None else shapes
        self.shape_weights = np.zeros((len(self.shapes) + 1, len(KINDS))) if shape_weights is None else shape_weights

    def shape_of(self, shape: np.ndarray) -> np.ndarray:
        """The place of each shape in the table; one past its end for unknown ones."""
        if not len(self.shapes):
            return np.zeros(len(shape), np.int64)
        at = np.minimum(np.searchsorted(self.shapes, shape), len(self.shapes) - 1)
        return np.where(self.shapes[at] == shape, at, len(self.shapes))

    def values(self, tokens: Tokens, i: np.ndarray, j: np.ndarray, shape: np.ndarray) -> np.ndarray:
        place = self.shape_of(shape)
        return tokens.features(i, j, place < len(self.shapes)) @ self.weights.T + self.shape_weights[place]

    def segments(self, tokens: Tokens) -> Iterator[tuple[int, int, int, float]]:
        """(first, past last, label, value) of the segments that may be in a best labelling, by their begin.

        A segment that never scores more than its tokens outside any entity, whatever its neighbours
        are, is in none. Starts are looked at in parts, so that memory does not grow with stretches.
        """
        gain = (self.link[:, 1:] - self.link[:, :1]).max(0) + (self.link[1:, :] - self.link[:1, :]).max(1)
        for low in range(0, len(tokens), PART):
            i, j, shape = tokens.candidates(low, min(low + PART, len(tokens)))
            if not len(i):
                continue
            values = self.values(tokens, i, j, shape)
            s, y = np.nonzero(values + gain[None, :] > ((j - i - 1) * self.link[0, 0])[:, None])
            yield from zip(i[s].tolist(), j[s].tolist(), (y + 1).tolist(), values[s, y].tolist(), strict=True)

    def best(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the best labelling of a text.

        Segments that touch or overlap are decided together by a bounded dynamic program; an outside
        token between two of them makes them independent.
        """
        tokens = Tokens(text)
        out, group, reach = [], [], -1
        for segment in self.segments(tokens):
            if segment[0] > reach and group:
                out += self._decide(group, len(tokens))
                group = []
            group.append(segment)
            reach = max(reach, segment[1])
        out += self._decide(group, len(tokens))
        return [(int(tokens.start[a]), y - 1, int(tokens.end[b - 1])) for a, y, b in out]

    def _decide(self, group: list[tuple[int, int, int, float]], n: int) -> list[tuple[int, int, int]]:
        if not group:
            return []
        link, labels = self.link.tolist(), range(len(KINDS) + 1)
        low, high = group[0][0], max(s[1] for s in group)
        if high < n:
            high += 1  # the outside token that ends the group
        ending: dict[int, list] = {}
        for s in group:
            ending.setdefault(s[1], []).append(s)
        top = [[LOW] * len(labels) for _ in range(high - low + 1)]
        back: list[list] = [[None] * len(labels) for _ in range(high - low + 1)]
        top[0][0] = 0.0
        for j in range(low + 1, high + 1):
            here, before = top[j - low], top[j - 1 - low]
            k = max(labels, key=lambda x: before[x] + link[x][0])
            here[0], back[j - low][0] = before[k] + link[k][0], (j - 1, k)
            for i, _, y, v in ending.get(j, ()):
                start = top[i - low]
                k = max(labels, key=lambda x: start[x] + link[x][y])
                if (got := start[k] + link[k][y] + v) > here[y]:
                    here[y], back[j - low][y] = got, (i, k)
        j, y, out = high, max(labels, key=lambda x: top[high - low][x]), []
        while j > low:
            i, k = back[j - low][y]
            if y:
                out.append((i, y, j))
            j, y = i, k
        return out[::-1]


# --- training ---------------------------------------------------------------------------------


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis)
    return m + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis))


class Grid:
    """Examples of up to ``width`` tokens side by side: every segment has a cell (example, first token, length)."""

    def __init__(self, examples: list[tuple[Tokens, list[tuple[int, int, int]]]], shapes: np.ndarray):
        self.sizes = np.array([len(t) for t, _ in examples], np.int64)
        self.width = int(self.sizes.max(initial=1))
        model, cells, features, places, golds = SpanModel(shapes=shapes), [], [], [], []
        self.pairs = np.zeros((len(KINDS) + 1,) * 2)
        for e, (tokens, gold) in enumerate(examples):
            i, j, shape = tokens.candidates(0, len(tokens))
            place = model.shape_of(shape)
            cells.append(np.column_stack([np.full(len(i), e), i, j - i - 1]))
            features.append(tokens.features(i, j, place < len(shapes)))
            places.append(place)
            label = {(a, b): k for a, k, b in gold}
            golds.append(np.array([label.get(x, -1) for x in zip(i.tolist(), j.tolist(), strict=True)], np.int64).reshape(-1))
            at, last = 0, 0
            for a, k, b in [*gold, (len(tokens), None, None)]:
                for _ in range(a - at):
                    self.pairs[last, 0] += 1
                    last = 0
                if k is not None:
                    self.pairs[last, k + 1] += 1
                    last, at = k + 1, b
        self.cells, self.features, self.place, gold = np.concatenate(cells).astype(np.int64), np.concatenate(features), np.concatenate(places), np.concatenate(golds)
        self.gold = np.zeros((len(gold), len(KINDS)))
        self.gold[np.flatnonzero(gold >= 0), gold[gold >= 0]] = 1

    def expected(self, model: SpanModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chance of each segment and kind, expected pairs of labels, log Z of each example), by forward-backward over segments."""
        n, w, labels, link = len(self.sizes), self.width, len(KINDS) + 1, model.link
        values = self.features @ model.weights.T + model.shape_weights[self.place]
        v = np.full((n, w, MAX_TOKENS, len(KINDS)), LOW)
        e, i, k = self.cells.T
        v[e, i, k] = values
        forward, backward, ready = (np.full((w + 1, n, labels), LOW) for _ in range(3))
        forward[0, :, 0] = 0
        lengths = np.arange(MAX_TOKENS)
        for j in range(w + 1):
            if j:
                forward[j, :, 0] = ready[j - 1, :, 0]
                most = min(j, MAX_TOKENS)
                come = j - 1 - lengths[:most]
                forward[j, :, 1:] = _lse(ready[come][:, :, 1:] + v[:, come, lengths[:most]].transpose(1, 0, 2), 0)
            ready[j] = _lse(forward[j][:, :, None] + link[None], 1)
        for i in range(w, -1, -1):
            end = self.sizes == i
            if i < w:
                most = min(w - i, MAX_TOKENS)
                ahead = np.full((n, labels), LOW)
                ahead[:, 0] = backward[i + 1, :, 0]
                ahead[:, 1:] = _lse(v[:, i, :most].transpose(1, 0, 2) + backward[i + 1 : i + 1 + most, :, 1:], 0)
                backward[i] = _lse(link[None] + ahead[:, None, :], 2)
            backward[i, end] = 0
            backward[i, self.sizes < i] = LOW
        total = _lse(forward[self.sizes, np.arange(n)], 1)
        e, i, k = self.cells.T
        pairs = np.zeros_like(link)
        stay = forward[:-1] + backward[1:, :, :1] - total[None, :, None]
        pairs[:, 0] = np.exp(np.minimum(stay + link[None, None, :, 0], 0)).sum((0, 1))
        ahead = values + backward[i + k + 1, e, 1:] - total[e, None]
        both = np.exp(np.minimum(forward[i, e][:, :, None] + link[None, :, 1:] + ahead[:, None, :], 0))
        pairs[:, 1:] = both.sum(0)
        return both.sum(1), pairs, total


def _layouts(kind: int, part: str, rng: random.Random) -> str:
    """A span of a kind written another way, as people do where the plain pattern does not reach."""
    digits = _digits(part)
    if kind == 0:
        return part.replace("@", rng.choice([" @ ", "(at)", "[at]", "@ ", " (at) "]))
    if kind == 1:
        return part.replace(".", rng.choice([" . ", "[.]", "(.)", ". "]))
    if kind == 2:
        by = rng.choice([".", "/", "  ", " / ", " - "])
        whole = by.join(digits[k : k + 4] for k in range(0, len(digits), 4))
        return rng.choice([whole, whole, digits, " ".join(digits[k : k + 4] for k in range(0, len(digits), 4))])
    d = digits[-10:]
    a, b, c = d[:3], d[3:6], d[6:]
    return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"({a}){b}-{c}", f"1-{a}-{b}-{c}", f"{a}/{b}-{c}", f"1 ({a}) {b}-{c}"])


def _plain(kind: int, rng: random.Random) -> str:
    r = rng.randint
    if kind == 0:
        name = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=r(3, 8)))
        return f"{name()}{rng.choice(['', f'.{name()}', f'.{r(1, 99)}', str(r(1, 99)), '_x'])}@{rng.choice(['', f'mail{r(1, 9)}.'])}{name()}.{rng.choice(['com', 'org', 'de', 'co.uk'])}"
    if kind == 1:
        return ".".join(str(r(0, 255)) for _ in range(4))
    if kind == 2:
        body = "".join(str(r(0, 9)) for _ in range(15))
        return next(body + str(x) for x in range(10) if luhn(body + str(x)))
    return f"+1 ({r(200, 999)}) {r(200, 999)}-{r(1000, 9999)}"


def _unchecked(rng: random.Random) -> str:
    """A number as long as a card's whose check sum is wrong."""
    d = "".join(str(rng.randint(0, 9)) for _ in range(rng.choice([14, 15, 16, 16, 16, 16, 17, 18, 19])))
    d = next(x for x in (d[:-1] + str(k) for k in range(10)) if not luhn(x))
    return rng.choice([d, d, " ".join(d[k : k + 4] for k in range(0, len(d), 4)), "-".join(d[k : k + 4] for k in range(0, len(d), 4))])


def _clean(rng: random.Random) -> str:
    """Numbers and marks that are nobody's."""
    r = rng.randint
    return rng.choice([
        f"{r(1990, 2030)}-{r(1, 12):02d}-{r(1, 28):02d}", f"{r(1, 28)}/{r(1, 12)}/{r(1990, 2030)} {r(0, 23):02d}:{r(0, 59):02d}", f"{r(0, 23):02d}:{r(0, 59):02d}:{r(0, 59):02d}", f"version {r(0, 9)}.{r(0, 20)}.{r(0, 9)}", f"page {r(1, 900)}",
        f"{r(1, 99)}.{r(0, 99):02d} EUR", f"{r(1, 900)},{r(0, 999):03d},{r(0, 999):03d}", f"{r(10, 99)}-{r(100, 999)}", f"order {r(10**7, 10**9)}", "978-3-16-148410-0", f"{r(1, 9)} {r(1, 9)} {r(1, 9)} {r(1, 9)} {r(1, 9)} {r(1, 9)}",
        f"{r(1990, 2030)}-{r(1, 12):02d}-{r(1, 28):02d}T{r(0, 23):02d}:{r(0, 59):02d}:{r(0, 59):02d}Z", f"CC BY-NC {r(1, 4)}.0", f"{rng.getrandbits(160):040x}", _unchecked(rng), _unchecked(rng), _unchecked(rng), f"{r(1, 99)}, {r(1, 99)}, {r(1, 99)}, {r(1, 99)}", f"@ {r(1, 99)}", f"meet at {r(1, 12)}", f"{r(1, 99)}.{r(1, 99)}",
        f"{r(1990, 2030)} {r(1990, 2030)} {r(1990, 2030)}", f"section {r(1, 9)}.{r(1, 9)}.{r(1, 9)}.{r(300, 999)}", f"{r(100, 999)} {r(100, 999)}", f"{r(1000, 9999)}-{r(1000, 9999)}", f"{r(10, 99)} x {r(10, 99)} x {r(10, 99)}", f"@{rng.choice(['home', 'work', 'media'])}",
        " ".join(str(r(100, 999)) for _ in range(r(3, 9))), " ".join(str(r(1, 99)) for _ in range(r(3, 12))), ", ".join(str(r(100, 9999)) for _ in range(r(3, 9))), f"{r(1, 255)}.{r(0, 255)}.{r(0, 255)}", f"{r(100, 999)}.{r(100, 999)}", f"{r(100, 999)}-{r(100, 999)}", f"{r(10**9, 10**10 - 1)}",
    ])


_WORDS = "the of and call mail to on lorem ipsum dolor, sit amet. der die und la le de que el. no for write reach ask card phone from server".split()


def made_up(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, spans) with plain and other layouts of each kind and clean numbers between words."""
    rng, out = random.Random(seed), []
    for e in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(rng.choices(_WORDS, k=rng.randint(1, 5))) + rng.choice([" ", " ", ": ", "\n"])
            if rng.random() < 0.6:
                kind = (e + rng.randint(0, 1)) % len(KINDS)
                part = _plain(kind, rng)
                if rng.random() < 0.65:
                    part = _layouts(kind, part, rng)
                if kind == 2 and rng.random() < 0.2:
                    text += f"{rng.randint(1, 99)} "
                spans.append((len(text), kind, len(text) + len(part)))
            else:
                part = _clean(rng)
            text += part + rng.choice([" ", ". ", ", ", " "])
        out.append((text + " ".join(rng.choices(_WORDS, k=rng.randint(0, 4))), spans))
    return out


def _example(text: str, spans: list[tuple[int, int, int]]) -> tuple[Tokens, list[tuple[int, int, int]]] | None:
    """Tokens and token spans; None where a span is no candidate, or spans overlap."""
    tokens = Tokens(text)
    i, j, _ = tokens.candidates(0, len(tokens))
    place = {(int(tokens.start[a]), int(tokens.end[b - 1])): (a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    spans = sorted(spans)
    if not len(tokens) or any((a, b) not in place for a, _, b in spans) or any(x[2] > y[0] for x, y in zip(spans, spans[1:], strict=False)):
        return None
    return tokens, [(place[a, b][0], k, place[a, b][1]) for a, k, b in spans]


def windows_of(text: str, most: int) -> list[str]:
    """Pieces of a text around digits and at signs, of WINDOW tokens, at most ``most``."""
    tokens, out, at = Tokens(text), [], 0
    for t in np.flatnonzero(tokens.trigger).tolist():
        if t >= at and len(out) < most:
            a, b = max(0, t - MARGIN), min(len(tokens), t - MARGIN + WINDOW)
            out.append(text[tokens.start[a] : tokens.end[b - 1]])
            at = b
    return out


def train(pieces: list[str], steps: int = STEPS, rate: float = 1.0, ridge: float = 3e-4, made: int = MADE) -> SpanModel:
    """Maximises the likelihood of labelled pieces of text (adaptive gradient steps).

    Pieces of the corpus are labelled by the plain patterns, and each that holds a span is also learnt
    with its spans in other layouts; ``made`` invented texts add layouts and clean numbers that the sample may lack.
    """
    rng, texts = random.Random(SEED), list(made_up(made, SEED))
    for piece in sorted(pieces):
        spans = base_spans(piece)
        texts.append((piece, spans))
        if spans and all(x[2] <= y[0] for x, y in zip(spans, spans[1:], strict=False)):
            text, at, moved = "", 0, []
            for a, k, b in spans:
                text += piece[at:a]
                part = _layouts(k, piece[a:b], rng)
                moved.append((len(text), k, len(text) + len(part)))
                text, at = text + part, b
            texts.append((text + piece[at:], moved))
    examples = [x for t, s in texts if (x := _example(t, s)) and len(x[0]) <= WINDOW * 3 // 2]
    if not examples:
        empty = SpanModel()
        empty.weights[:, 0] = -5.0
        return empty
    shapes: dict[int, int] = {}
    for tokens, gold in examples:
        i, j, shape = tokens.candidates(0, len(tokens))
        own = {(a, b) for a, _, b in gold}
        for a, b, s in zip(i.tolist(), j.tolist(), shape.tolist(), strict=True):
            if (a, b) in own:
                shapes[s] = shapes.get(s, 0) + 1
    table = np.array(sorted(s for s, n in shapes.items() if n > 1), np.uint64)
    grid = Grid(examples, table)
    model = SpanModel(shapes=table)
    slope = lambda got: (got.T @ grid.features, np.stack([np.bincount(grid.place, got[:, k], len(table) + 1) for k in range(len(KINDS))], 1))
    gold_w, gold_s = slope(grid.gold)
    now = [model.weights, model.link, model.shape_weights]
    seen = [np.full(x.shape, 1e-8) for x in now]
    for _ in range(steps):
        chance, pairs, _ = grid.expected(model)
        got_w, got_s = slope(chance)
        grow = [(gold_w - got_w) / len(examples) - ridge * now[0], (grid.pairs - pairs) / len(examples) - ridge * now[1], (gold_s - got_s) / len(examples) - ridge * now[2]]
        seen = [s + g**2 for s, g in zip(seen, grow, strict=True)]
        now = [x + rate * g / np.sqrt(s) for x, g, s in zip(now, grow, seen, strict=True)]
        model = SpanModel(now[0], now[1], table, now[2])
    return model


def find(text: str, model: SpanModel) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) as (start, kind, end); the model's spans stay clear of base ones."""
    if not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    busy = sorted((a, b) for a, _, b in base)
    added = []
    starts = [a for a, _ in busy]
    reach = np.maximum.accumulate([b for _, b in busy]) if busy else []
    for a, k, b in model.best(text):
        i = int(np.searchsorted(starts, b, "left"))  # spans that start before b
        if i == 0 or reach[i - 1] <= a:
            added.append((a, k, b))
    return base, sorted(base + added)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def sample(docs: DataFrame, most: int = TRAIN_TEXTS) -> list[str]:
    """Pieces around digits and at signs of about ``most`` texts, those of the least hashes of doc_id.

    The driver holds ``TRAIN_WINDOWS`` pieces of ``WINDOW`` tokens a text at most, no whole text.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_pydict({"piece": pa.array([x[:MAX_PIECE] for x in windows_of(text, TRAIN_WINDOWS)], pa.string())})

    mark = F.xxhash64("doc_id")
    last = docs.select(mark.alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if last is None:
        return []
    picked = docs.filter((mark <= last) & F.col("text").rlike(_TRIGGER.pattern)).select("text").mapInArrow(cut, "piece string")
    return [r.piece for r in picked.limit(most * TRAIN_WINDOWS).collect()]  # equal doc_ids have equal hashes


def labelled(docs: DataFrame, model: SpanModel) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of ``docs`` (doc_id, text).

    Counts and base_sha256 are of the base spans, ``spans`` has all of them: kind:start:end in code
    points, end exclusive, by start, then kind, joined by commas. Null and empty texts have none.
    Repeated rows and null doc_ids are rows like others; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            counts, shas, spans = [], [], []
            for text in batch.column("text").to_pylist():
                base, every = find(text or "", model)
                counts.append([sum(k == x for _, k, _ in base) for x in range(len(KINDS))])
                shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            table = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(table[:, k]) for k in range(len(KINDS))], pa.array(shas), pa.array(spans)], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def op4_pii(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return labelled(docs, train(sample(docs)))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, overlapping ones as one, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: SpanModel) -> DataFrame:
    """``docs``, all columns, with every span in ``text`` replaced by its kind; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts = [None if t is None else redacted(t, find(t, model)[1]) for t in batch.column("text").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, batch.schema.field("text").type))

    return docs.mapInArrow(run, docs.schema)
