"""Counts and phrases of a text found in one pass each, against the rules word by word."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ticketlens import config
from ticketlens.functions.regex import SPACES
from ticketlens.functions.score import marks
from ticketlens.functions.text import root_cause

TEXTS = (
    "", " ", "a", "ab", "İ x", "aaab baaa xyzzz", "bcdfg strngths rhythms bcdf-g", "it's b.c.d ok", "hmm  grrr tsk　zzz\n\tpst", "ñññ bçd 😀 😀😀 x😀",
    "Root-Cause: none", "se identificó", "the fixture held", "RESOLVED", "aaaa bbbbbb aaabbbbb cccccc", "\x85ab\x1cc d e", "b1c2d aaa1 a1a1a",
)


def _expected(text: str) -> tuple:
    low = text.lower()
    words = [w for w in re.split(f"[{re.escape(SPACES)}]+", text) if len(w) > 1]
    letters = [re.sub("[^a-z]", "", w) for w in re.split(f"[{re.escape(SPACES)}]+", low)]
    odd = [w for w in letters if re.search(r"(.)\1{2}|[bcdfghjklmnpqrstvwxyz]{5}$|^[^aeiou]{3,5}$", w)]
    return len(words), len(odd), *(any(p in low for p in x) for x in (config.ROOT_CAUSE_PHRASES, config.STEP_PHRASES))


def test_marks_follow_the_rules_word_by_word(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "i int, x string")
    got = {r.i: tuple(r.m) for r in rows.select("i", marks(F.col("x"), F.lower("x")).alias("m")).collect()}
    assert got == {i: _expected(x) for i, x in enumerate(TEXTS)}


def test_a_sentence_is_put_in_lower_case_once(spark):
    plan = spark.range(1).select(root_cause(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("lower(") < 5  # once for the text and once for a sentence, not once for each phrase


def test_sentences_are_cut_where_they_were(spark):
    texts = ("- due to a; it was b. Found that c is broken", "x due to\n\n* because of the rain", "1.due to x", "•  caused by hail! ok", "Not a - due to wind in trees", "A.B caused by C.D")
    expected = []
    for x in texts:
        parts = [p.strip() for p in re.split(r"(?<=[.!?;])\s+|\n+|(?:^|\s)[-•*]\s+", x)]
        expected.append(next((p for p in parts if any(y in p.lower() for y in config.ROOT_CAUSE_PHRASES) and len(p) >= 8), ""))
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    assert [r.c for r in rows.select("i", root_cause(F.col("x")).alias("c")).orderBy("i").collect()] == expected
