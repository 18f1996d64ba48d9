"""Scalar text operators: cleaning, journals, tokens, categories, root causes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketlens import config
from ticketlens.functions.regex import SPACE, bound, contains_any, java, stems, trim


def _replaced(needs: str, pattern: str, by: str) -> Callable[[Column], Column]:
    return lambda x: F.when(F.contains(x, F.lit(needs)), F.regexp_replace(x, pattern, by)).otherwise(x)


def clean_text(text: Column) -> Column:
    """Line breaks made one kind; code marks, tags, links and machine time stamps out; long gaps shortened.

    The patterns are fixed values, in a fixed order.
    """
    t = F.coalesce(text, F.lit(""))
    # a pattern is tried only where what it needs is there
    for needs, pattern, by in (
        ("_x000D_", "_x000D_", "\n"), ("\r", "\\r\\n?", "\n"), ("code]", r"\[/?code\]", ""), (">", "<[^>]+>", ""), ("://", java(r"https?://\S+", ""), "[URL]"),
        ("nav_to.do", java(r"nav_to\.do\S+", ""), "[URL]"), ("Z", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z", ""),
    ):
        t = bound(t, _replaced(needs, pattern, by))
    return trim(F.regexp_replace(t, f"[{SPACE}]{{3,}}", "  "))


def has_phrase(text: Column, phrases: tuple[str, ...]) -> Column:
    return bound(F.lower(text), lambda t: contains_any(t, phrases))


def is_auto_description(text: Column) -> Column:
    return has_phrase(F.coalesce(text, F.lit("")), config.AUTO_DESCRIPTION_PHRASES)


#: A line "<time> - <author> (<journal>)"; groups: what comes before the line, time, author.
NOTE_HEADER = (
    r"(^|\n|_x000D_)[ \t]*((?:\d{4}-\d{2}-\d{2}|\d{1,2}[/.-]\d{1,2}[/.-]\d{4})[ T]+\d{1,2}:\d{2}(?::\d{2})?(?:[ \t]*[AaPp][Mm])?)"
    r"[ \t]*-[ \t]*([^\n]+?)[ \t]*\([^()\n]+\)[ \t]*(?=_x000D_|\n|\z)"
)
NOTE_TYPE = "array<struct<timestamp:string,author:string,text:string,is_system:boolean>>"


def parse_notes(journal: Column) -> Column:
    """Journal text to an array of notes. Text before the first header is dropped; without any header it is one note.

    The control characters 1 to 3 mark the cuts and are taken out of the journal first.
    """
    def note(part: Column) -> Column:
        at = trim(F.regexp_extract(part, "^([^\x02]*)\x02", 1))
        author = trim(F.regexp_extract(part, "^[^\x02]*\x02([^\x03]*)\x03", 1))
        text = clean_text(F.regexp_replace(part, "^[^\x03]*\x03", ""))

        def built(x: Column) -> Column:
            system = F.lower(x["author"]).isin(*config.SYSTEM_AUTHORS) | has_phrase(x["text"], config.SYSTEM_PHRASES)
            return F.struct(at.alias("timestamp"), x["author"].alias("author"), x["text"].alias("text"), system.alias("is_system"))

        return bound(F.struct(author.alias("author"), text.alias("text")), built)

    def read(raw: Column) -> Column:
        whole = F.array(F.struct(F.lit("").alias("timestamp"), F.lit("Unknown").alias("author"), clean_text(raw).alias("text"), F.lit(False).alias("is_system")))
        parts = F.split(F.regexp_replace(raw, NOTE_HEADER, "$1\x01$2\x02$3\x03"), "\x01")
        cut = lambda x: F.when(F.size(x) > 1, F.transform(F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), note)).when(trim(raw) != "", whole).otherwise(F.lit(None).cast(NOTE_TYPE))
        return bound(parts, cut)

    return bound(F.regexp_replace(F.translate(F.coalesce(journal, F.lit("")), "\x01\x02\x03", ""), "\\r\\n?", "\n"), read).cast(NOTE_TYPE)


def tokens(text: Column) -> Column:
    """Distinct significant words in order of appearance."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\[url\]", " ")
    t = F.regexp_replace(t, java(r"\S+@\S+", ""), " ")
    t = F.regexp_replace(t, rf"[^\p{{L}}\p{{N}}{SPACE}]", " ")
    words = F.split(t, f"[{SPACE}]+")
    mixed = lambda w: w.rlike("^[0-9]+$") | (w.rlike("[a-z]") & w.rlike("[0-9]"))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*config.STOP_WORDS) & ~mixed(w)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def normalized_key(text: Column) -> Column:
    return F.array_join(F.array_sort(tokens(text)), " ")


def truncate(text: Column, most: int) -> Column:
    """One line of at most ``most`` characters, cut at a space past 60 % of them, with an ellipsis."""
    clean = trim(F.regexp_replace(text, f"[{SPACE}]+", " "))
    cut = F.substring(clean, 1, most)
    at = F.length(cut) - F.length(F.substring_index(cut, " ", -1)) - 1
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.when(at > most * 0.6, F.left(cut, at)).otherwise(cut), F.lit("…")))


def category(short: Column, body: Column) -> Column:
    """The first category that the short description names, else that the body names.

    Patterns, which are in lower case, are tried only on texts that have the beginning of one of their words.
    """

    def named(t: Column) -> Column:
        out = F
        for name, words in config.CATEGORIES:
            out = out.when(contains_any(t, stems(words)) & t.rlike(java(rf"\b(?:{words})\b", "")), F.lit(name))
        return out.otherwise(F.lit(None).cast("string"))

    return F.coalesce(bound(F.lower(short), named), bound(F.lower(body), named), F.lit(config.UNCATEGORIZED))


def root_cause(text: Column, caused: Column | None = None) -> Column:
    """The first sentence with a root-cause phrase and 8 characters or more, at most 180 long; else blank.

    ``caused`` is whether the text has such a phrase, where the caller knows it.
    """
    # no cut begins at a letter or digit, which one look tells
    sentences = F.split(text, "(?![A-Za-z0-9])(?:" + java(r"(?<=[.!?;])\s+|\n+|(?:^|\s)[-•*]\s+", "") + ")")
    strip = lambda s: trim(F.regexp_replace(trim(s), f"^[,:;\\-{SPACE}]+", ""))
    good = F.filter(sentences, lambda s: has_phrase(s, config.ROOT_CAUSE_PHRASES) & (F.length(strip(s)) >= 8))
    found = F.when(has_phrase(text, config.ROOT_CAUSE_PHRASES) if caused is None else caused, bound(F.get(good, F.lit(0)), lambda s: truncate(strip(s), 180)))
    return F.coalesce(found, F.lit(""))


def signature(short: Column, body: Column) -> Column:
    return F.when(F.length(trim(short)) >= 8, trim(short)).otherwise(F.substring(body, 1, 200))
