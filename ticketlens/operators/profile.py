"""Data-quality profile of a loaded table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.dates import timestamp
from ticketlens.functions.regex import known, round_half_up

FIELDS = ("assignment_group", "assigned_to", "channel", "opened", "closed", "work_notes", "service", "service_offering", "resolution_code")
VALUE_FIELDS = ("assignment_group", "channel", "service", "service_offering", "resolution_code")


def field_presence(t: DataFrame) -> DataFrame:
    """(field, status, non_empty, empty, coverage): ABSENT where the table has no such column."""
    there = [f for f in FIELDS if f in t.columns]
    counts = t.agg(F.count("*").alias("_n"), *[F.count_if(known(F.col(f).cast("string")).isNotNull()).alias(f) for f in there])
    rows = [F.struct(F.lit(f).alias("field"), F.lit("PRESENT" if f in there else "ABSENT").alias("status"), (F.col(f) if f in there else F.lit(None).cast("long")).alias("non_empty")) for f in FIELDS]
    out = counts.select("_n", F.explode(F.array(*rows)).alias("r")).select("_n", "r.*")
    return out.select("field", "status", "non_empty", (F.col("_n") - F.col("non_empty")).alias("empty"), F.round(F.try_divide("non_empty", "_n"), 6).alias("coverage"))


def field_values(t: DataFrame) -> DataFrame:
    """(field, value, n) of every non-blank value of the categorical fields, one pass."""
    there = [f for f in VALUE_FIELDS if f in t.columns]
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), known(F.col(f).cast("string")).alias("value")) for f in there])
    return t.select(F.explode(pairs).alias("p")).select("p.*").filter("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("n"))


def co_occurrence(t: DataFrame, left: str, right: str) -> DataFrame:
    """One row on how two fields go together in the tickets that have both."""
    pairs = t.select(known(F.col(left)).alias("l"), known(F.col(right)).alias("r")).filter("l IS NOT NULL AND r IS NOT NULL").groupBy("l", "r").agg(F.count("*").alias("n"))

    def side(key: str, many: str, most: str) -> DataFrame:
        return pairs.groupBy(key).agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias(many), F.coalesce(F.max("k"), F.lit(0)).alias(most))

    return pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("incidents"), F.count("*").alias("pairs")).crossJoin(side("l", "left_with_many", "max_right")).crossJoin(side("r", "right_with_many", "max_left"))


def date_coverage(t: DataFrame, field: str) -> DataFrame:
    """First and last readable date as text, dated and undated tickets."""
    good = F.when(timestamp(F.col(field)).isNotNull(), F.col(field))
    return t.agg(F.min(good).alias("first"), F.max(good).alias("last"), F.count(good).alias("dated"), (F.count("*") - F.count(good)).alias("undated"))


def sla_signal(t: DataFrame, present: bool = True) -> DataFrame:
    """not-available without the column or any flag, no-signal if all flags agree, else available with the share missed."""
    met, missed = F.count_if(F.col("made_sla")), F.count_if(~F.col("made_sla"))
    state = F.when(F.lit(not present) | (met + missed == 0), "not-available").when((met == 0) | (missed == 0), "no-signal").otherwise("available")
    return t.agg(state.alias("state"), F.when((met > 0) & (missed > 0) & F.lit(present), round_half_up(missed / (met + missed) * 100.0, 1)).alias("breach_pct"), (met + missed).alias("recorded"))
