"""White space as one class, in patterns and at the ends of texts, and the score's spelling."""

from pyspark.sql import functions as F

from ticketlens.functions.regex import SPACE, SPACES, java, trim
from ticketlens.functions.score import _spelling


def test_white_space_is_the_same_everywhere(spark):
    rows = spark.range(1, 0xFFFF).filter("id NOT BETWEEN 55296 AND 57343").withColumn("c", F.decode(F.expr("unhex(lpad(hex(id), 4, '0'))"), "UTF-16BE"))
    for hit in (F.col("c").rlike(f"^[{SPACE}]\\z"), ~F.col("c").rlike(f"^[^{SPACE}]\\z"), F.col("c").rlike(java(r"\A\s\z")), trim(F.col("c")) == ""):
        assert {r.c for r in rows.filter(hit).collect()} == set(SPACES)


def test_trim_ends_at_the_text_and_nowhere_else(spark):
    texts = [" a \x85", " ﻿a b\n\r\n", "\t \n", "", None, "a"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(trim(F.col("x"))).collect()]
    assert got == ["a \x85", "a b", "", "", None, "a"]


def test_spelling_counts_words_as_they_stand(spark):
    cases = {"": 95, "one two": 95, "xyz bcd fgh": 30, "a b c brr": 30, "ok " * 20 + "soooon": 75, "abc-bcdfg abc abc abc abc": 30, "Ñbc's ée" + " fine" * 5: 55}
    got = {r.x: r.s for r in spark.createDataFrame([(x,) for x in cases], "x string").select("x", _spelling(F.col("x")).alias("s")).collect()}
    import re

    def want(text):
        words = [w for w in re.split(r"\s+", text) if len(w) > 1]
        odd = [w for w in (re.sub("[^a-z]", "", w.lower()) for w in words) if re.search(r"(.)\1{2,}", w) or re.search("[bcdfghjklmnpqrstvwxyz]{5,}$", w) or 3 <= len(w) <= 5 and not re.search("[aeiou]", w)]
        share = len(odd) / len(words) if words else 0.0
        return 95 if share < 0.03 else 75 if share < 0.08 else 55 if share < 0.15 else 30

    assert got == {x: want(x) for x in cases}
