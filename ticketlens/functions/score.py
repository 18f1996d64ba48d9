"""Documentation score of a ticket: five dimensions, label and feedback, as one struct."""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ticketlens import config
from ticketlens.functions.regex import WHITE, any_of, bound, contains_any, java, round_half_up

#: Notes that say nothing (fixed values).
NOISE = tuple(java(p) for p in (
    r"^hi team[,.]?\s*(please\s+)?(assist|check|help|look into|provide assistance)",
    r"^please (check|assist|help|look into|take a look)",
    r"^(hardware/dispatch|software/application)\s*\n?\s*[A-Za-z0-9_]*\s*\z",
    r"^(na|n/a)\s*\z",
    r"^predicted ag:",
    r"^attachment added\s*\z",
    r"^(hi|hello|dear)\s+team",
    r"this incident will be closed due (yo|to) has been completed",
))
#: Patterns (fixed values, in lower case), what a text that matches has literally, and messages.
SLANG = tuple((java(p, f), s, m) for p, f, s, m in (
    (r"\bwip\b", "", ("wip",), "Filler: WIP"),
    (r"\btbd\b", "", ("tbd",), "Vague: TBD"),
    (r"\bgonna\b", "", ("gonna",), "Informal: gonna"),
    (r"\bwanna\b", "", ("wanna",), "Informal: wanna"),
    (r"\bpls\b|\bplz\b", "", ("pls", "plz"), "Informal: pls/plz"),
    (r"due (yo)\b", "", ("due yo",), "Typo: due yo"),
    (r"^hi[,.]?\s*team", "m", ("team",), "Generic opener: Hi team"),
    (r"please (check|assist|help)\s+the?\s*user", "", ("please ",), "Vague handoff"),
))


def combined_text(body: Column, notes: Column) -> Column:
    return F.array_join(F.concat(F.array(body), F.transform(notes, lambda n: n["text"])), "\n")


def label(total: Column) -> Column:
    return F.when(total >= 80, "Excellent").when(total >= 55, "Good").when(total >= 30, "Poor").otherwise("Critical")


_CONSONANT = "[bcdfghjklmnpqrstvwxyz]"
#: An odd word from its first odd place to its end, in a text of letters and white space: a letter three times, five consonants at the end, short without a vowel.
ODD = "(?:" + "|".join(x * 3 for x in ascii_lowercase) + rf"|{_CONSONANT}{{5}}\b|\b{_CONSONANT}{{3,5}}\b)[a-z]*"


@F.arrow_udf(StructType().add("words", "integer").add("odd", "integer").add("cause", "boolean").add("steps", "boolean"))
def _marks(text: pa.Array, lowered: pa.Array) -> pa.Array:
    """Words of two characters or more, suspicious ones, and whether there are phrases of causes and of steps: a pass of a linear automaton each, whatever the number of phrases."""
    # words of one character are never odd, so the letters of all words can be taken out of the whole text at once
    letters = pc.replace_substring_regex(lowered, f"[^a-z{WHITE}]+", "")
    columns = [pc.count_substring_regex(text, f"[^{WHITE}]{{2,}}"), pc.count_substring_regex(letters, ODD)]
    columns = [c.cast(pa.int32()) for c in columns] + [pc.match_substring_regex(lowered, any_of(p)) for p in (config.ROOT_CAUSE_PHRASES, config.STEP_PHRASES)]
    return pa.StructArray.from_arrays(columns, ["words", "odd", "cause", "steps"])


def marks(text: Column, lowered: Column) -> Column:
    """struct<words, odd, cause, steps> of a text that is not null and its lower case."""
    return _marks(text, lowered)


def _spelling(text: Column, found: Column | None = None) -> Column:
    """Points for the share of suspicious words."""
    ratio = bound(_marks(text, F.lower(text)) if found is None else found, lambda c: F.when(c["words"] == 0, F.lit(0.0)).otherwise(c["odd"] / c["words"]))
    return bound(ratio, lambda x: F.when(x < 0.03, 95).when(x < 0.08, 75).when(x < 0.15, 55).otherwise(30))


def ticket_score(short: Column, body: Column, auto: Column, state: Column, notes: Column, lowered: Column, found: Column) -> Column:
    """struct<total, label, dims, feedback, noise_ratio, note_count, note_chars>; feedback in a fixed order.

    ``lowered`` is the combined text in lower case, ``found`` its ``marks``.
    """
    tagged = short.rlike(r"^\[.+?\]\[.+?\]")
    noise = F.filter(notes, lambda n: reduce(lambda a, p: a | n["text"].rlike(p), NOISE, F.length(n["text"]) < 12))
    slang = bound(lowered, lambda t: F.array(*[F.when(contains_any(t, s) & t.rlike(p), 1).otherwise(0) for p, s, _ in SLANG]))
    parts = F.struct(
        F.when(F.length(short) <= 9, 0).when(F.length(short) <= 24, 40).when(tagged, 60).otherwise(100).alias("short"),
        F.when(auto, 70).when(F.length(body) <= 49, 0).when(F.length(body) <= 149, 50).otherwise(100).alias("body"),
        F.when(found["cause"], 100).otherwise(0).alias("cause"),
        F.when(found["steps"], 100).when(F.lower(state).isin("closed", "resolved"), 0).otherwise(30).alias("steps"),
        _spelling(lowered, found).alias("spelling"),
        F.size(noise).alias("noisy"),
        slang.alias("slang"),
    )
    # what costs time is worked out once for each row
    return bound(parts, lambda p: _scored(p, notes))


def _scored(p: Column, notes: Column) -> Column:
    short_score, body_score, cause, steps, spelling = (p[c] for c in ("short", "body", "cause", "steps", "spelling"))
    slang = [F.get(p["slang"], F.lit(k)) for k in range(len(SLANG))]
    count = F.size(notes)
    noise_ratio = F.when(count > 0, p["noisy"] / count).otherwise(F.lit(0.0))
    manner = F.greatest(F.lit(0.0), F.lit(100) - reduce(lambda a, b: a + b, slang) * 15 - noise_ratio * 60)
    dims = [round_half_up(short_score * 0.4 + body_score * 0.6), cause, steps, spelling, round_half_up(manner)]
    total = round_half_up(reduce(lambda a, b: a + b, [d * w for d, w in zip(dims, config.WEIGHTS, strict=True)])).cast("int")
    said = [
        F.when(short_score == 0, "Short description is missing or too short.").when(short_score == 40, "Short description is too vague."),
        F.when(body_score == 70, "Description is auto-generated from monitoring alert.").when(body_score == 0, "Description is empty or too short.").when(body_score == 50, "Description is brief — add more context."),
        F.when(cause == 0, "No root cause documented."),
        F.when(steps == 0, "Closed without documenting resolution steps.").when(steps == 30, "No resolution steps documented yet."),
        F.when(spelling == 55, "Some spelling issues detected.").when(spelling == 30, "Significant spelling issues detected."),
        *[F.when(s == 1, m) for s, (_, _, m) in zip(slang, SLANG, strict=True)],
        F.when(count == 0, "No human work notes found."),
    ]
    chars = F.aggregate(notes, F.lit(0), lambda a, n: a + F.length(n["text"]))
    return F.struct(
        total.alias("total"),
        label(total).alias("label"),
        F.struct(*[d.cast("int").alias(n) for d, n in zip(dims, config.DIMS, strict=True)]).alias("dims"),
        F.array_compact(F.array(*said)).alias("feedback"),
        noise_ratio.alias("noise_ratio"),
        count.alias("note_count"),
        chars.alias("note_chars"),
    )
