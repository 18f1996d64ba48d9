"""Exact medians of groups of any size, by distributed selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.plans.shared import prefix_sum

#: Buckets a power of two: values of one bucket are within about one part in 90 of each other.
BUCKETS = 64


def _bucket(v: Column) -> Column:
    """A histogram's bucket, which never falls as the value grows."""
    return (F.signum(v) * F.floor(F.log2(F.abs(v) + 1) * BUCKETS)).cast("long")


def medians(t: DataFrame, by: list[str], value: Column, out: str = "median") -> DataFrame:
    """(by, out): the median of ``value``, null values left out; a group without values has no row.

    A group's values are counted each, then by histogram bucket. The buckets' running counts, few rows a group, tell how many values come before each
    bucket, and places are given out inside buckets only. The one or two values that hold the middle places are the answer. No
    state ever holds all values of a group, and a group's buckets are spread over tasks.
    """
    counts = t.select(*by, value.cast("double").alias("_v")).filter(F.col("_v").isNotNull()).groupBy(*by, "_v").agg(F.count("*").alias("_k"))
    placed = prefix_sum(counts, by, F.col("_k"), ["_v"], "_before", _bucket(F.col("_v")))
    totals = counts.groupBy(*by).agg(F.sum("_k").alias("_n")).select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], "_n")
    on = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
    placed = placed.join(totals, on) if by else placed.crossJoin(totals)
    holds = lambda place: (F.col("_before") <= place) & (place < F.col("_before") + F.col("_k"))
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    middle = placed.filter(holds(low) | holds(high))
    return middle.groupBy(*by).agg(((F.max(F.when(holds(low), F.col("_v"))) + F.max(F.when(holds(high), F.col("_v")))) / 2).alias(out))


def with_median(rows: DataFrame, t: DataFrame, by: list[str], value: Column, out: str) -> DataFrame:
    """``rows``, which have a row for each group, with the group's median in ``t``, null where it has none."""
    found = medians(t, by, value, out)
    if not by:  # one row at most; an aggregate makes it one
        return rows.crossJoin(found.agg(F.max(out).alias(out)))
    found = found.select(*[F.col(c).alias(f"_m{i}") for i, c in enumerate(by)], out)
    return rows.join(found, [F.col(c).eqNullSafe(F.col(f"_m{i}")) for i, c in enumerate(by)], "left").drop(*[f"_m{i}" for i in range(len(by))])
