"""Patterns and rounding whose meaning must not depend on the regular-expression engine."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as text tools on the web see it; Java's \s is ASCII only. One bit set and one range tell that most letters are none.
SPACE = r"\t\n\x0B\f\r \xA0[\x{1680}-\x{FEFF}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]"
#: The same characters in a class of RE2, which knows no intersections.
WHITE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same characters as a text.
SPACES = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_W = "[A-Za-z0-9_]"
#: An ASCII word boundary; Java's \b also counts accented letters as word characters.
EDGE = f"(?:(?<!{_W})(?={_W})|(?<={_W})(?!{_W}))"


def java(pattern: str, flags: str = "iu") -> str:
    """Java form of a pattern: ASCII word boundaries, Unicode white space, Unicode case folding."""
    out = re.sub(r"\[(\^?)([^\]]*)\\s([^\]]*)\]", lambda m: f"[{m[1]}{m[2]}{SPACE}{m[3]}]", pattern)
    out = out.replace(r"\b", EDGE).replace(r"\S", f"[^{SPACE}]")
    out = re.sub(r"\\s", lambda m: f"[{SPACE}]", out)
    return (f"(?{flags})" if flags else "") + out


def any_of(phrases: tuple[str, ...]) -> str:
    """An alternation of literal phrases that every engine reads alike."""
    return "|".join(re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", p) for p in phrases)


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Ties go up, below zero too."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5)


def pct(part: Column, whole: Column) -> Column:
    """Percentage with one decimal; 0 of nothing is 0."""
    return F.when(whole > 0, round_half_up(part / whole * 100.0, 1)).otherwise(F.lit(0.0))


def whole_pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, round_half_up(part / whole * 100.0)).otherwise(F.lit(0)).cast("long")


def known(c: Column) -> Column:
    """Trimmed text; blank is null."""
    t = trim(c)
    return F.when(t != "", t)


def contains_any(lowered: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a text in lower case has one of some literal phrases; a plain search, no pattern."""
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(p)) for p in phrases])


def stems(pattern: str) -> tuple[str, ...]:
    """What each alternative of a pattern begins with literally; a text without any of them cannot match."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(pattern):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append(pattern[last:i])
            last = i + 1
    out = []
    for part in [*parts, pattern[last:]]:
        stem = re.match(r"[^.(\[?*+{\\|^$]*", part)[0]
        out.append(stem[:-1] if part[len(stem) : len(stem) + 1] in ("?", "*", "{") else stem)
    return tuple(dict.fromkeys(out))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once for each row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
