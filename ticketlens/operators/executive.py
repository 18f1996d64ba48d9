"""Summary metrics of a population for a management page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.regex import known
from ticketlens.operators.medians import medians
from ticketlens.operators.origin import DIMENSIONS, with_dimensions
from ticketlens.operators.problems import by_name, ranked


def period_span(t: DataFrame) -> DataFrame:
    """(months, first_month, last_month) of dated tickets."""
    m = F.nullif(F.col("month"), F.lit(""))
    return t.agg(F.count_distinct(m).alias("months"), F.min(m).alias("first_month"), F.max(m).alias("last_month"))


def top_share(t: DataFrame, dimension: str, most: int = 3) -> DataFrame:
    """(named, distinct_values, n, share) of the ``most`` largest known values among all tickets."""
    counts = with_dimensions(t).groupBy(F.col(dimension).alias("value")).agg(F.count("*").alias("n"))
    r = ranked(counts.filter("value IS NOT NULL"), [], F.desc("n"), by_name("value"))
    shown = F.col("rank") <= most
    row = r.agg(F.count_if(shown).alias("named"), F.count("*").alias("distinct_values"), F.coalesce(F.sum(F.when(shown, F.col("n"))), F.lit(0)).alias("n"))
    return row.crossJoin(t.agg(F.count("*").alias("_a"))).select("named", "distinct_values", "n", F.round(F.try_divide("n", "_a"), 6).alias("share"))


def look_dimension(t: DataFrame) -> DataFrame:
    """(dimension): group if it has two known values or more, else service, else offering, else null."""
    row = t.agg(*[F.count_distinct(known(F.col(c))).alias(d) for d, c in DIMENSIONS.items()])
    return row.select(F.when(F.col("group") >= 2, "group").when(F.col("service") >= 2, "service").when(F.col("offering") >= 2, "offering").alias("dimension"))


def pattern_breadth(t: DataFrame, key: str = "cluster_id") -> DataFrame:
    return with_dimensions(t).groupBy(key).agg(*[F.count_distinct(d).alias(f"distinct_{d}s") for d in DIMENSIONS])


def median_hours(t: DataFrame) -> DataFrame:
    """One row, null without closed tickets."""
    return medians(t, [], F.col("resolution_hours"), "median_hours").agg(F.round(F.max("median_hours"), 6).alias("median_hours"))


def executive_metrics(t: DataFrame, key: str = "cluster_id") -> DataFrame:
    """One wide row: counts, recurring share, good share, share without diagnosis, largest problem, spans and top shares."""
    n = F.count("*")
    share = lambda c: F.round(F.try_divide(F.count_if(c), n), 6)
    base = t.agg(n.alias("total"), share(F.col("score.label").isin("Excellent", "Good")).alias("good_share"), share(F.col("score.dims.root_cause") == 0).alias("no_diagnosis_share"))
    clusters = t.groupBy(key).agg(n.alias("k")).filter("k >= 2").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("recurring"), F.coalesce(F.max("k"), F.lit(0)).alias("largest"))
    out = base.crossJoin(clusters).withColumns({"recurring_share": F.round(F.try_divide("recurring", "total"), 6), "largest_share": F.round(F.try_divide("largest", "total"), 6)}).drop("recurring", "largest")
    out = out.crossJoin(period_span(t)).crossJoin(median_hours(t)).crossJoin(look_dimension(t))
    for d in DIMENSIONS:
        out = out.crossJoin(top_share(t, d).select(F.col("distinct_values").alias(f"{d}_values"), F.col("share").alias(f"{d}_top_share")))
    return out
