"""KPIs and distributions over annotated tickets. Every function takes and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens import config
from ticketlens.functions.regex import pct, round_half_up, whole_pct
from ticketlens.operators.medians import with_median

TOTAL = "score.total"


def count_if(c: Column) -> Column:
    return F.coalesce(F.count_if(c), F.lit(0))


def mean1(c: Column | str) -> Column:
    """Mean with one decimal, 0 of nothing."""
    return F.coalesce(round_half_up(F.avg(c), 1), F.lit(0.0))


def breach_pct(digits: int = 1) -> Column:
    """Share of missed targets among closed tickets with a known one; null if there is none."""
    tracked = F.count_if(F.col("is_closed") & F.col("made_sla").isNotNull())
    missed = F.count_if(F.col("is_closed") & ~F.col("made_sla"))
    return F.when(tracked > 0, round_half_up(missed / tracked * 100.0, digits) if digits else whole_pct(missed, tracked))


def overview(t: DataFrame) -> DataFrame:
    """One row of documentation KPIs; zeros for an empty table."""
    n, labels = F.count("*"), {f"n_{x.lower()}": count_if(F.col("score.label") == x) for x in config.LABELS}
    row = t.agg(
        n.alias("total"),
        mean1(TOTAL).alias("avg_score"),
        *[c.alias(k) for k, c in labels.items()],
        count_if(F.col("score.dims.root_cause") == 0).alias("no_root_cause"),
        count_if(F.col("score.noise_ratio") > 0.5).alias("high_noise"),
        count_if(F.col("is_auto_desc")).alias("auto_generated"),
        count_if(F.col("score.note_count") == 0).alias("empty_notes"),
        F.coalesce(round_half_up(F.avg("score.note_chars")), F.lit(0)).cast("long").alias("avg_note_chars"),
        mean1("score.note_count").alias("avg_note_count"),
        pct(count_if(F.col("score.note_count") > 0), n).alias("has_human_notes_pct"),
    )
    row = with_median(row, t, [], F.col("score.note_chars"), "median_note_chars")
    return row.withColumn("median_note_chars", F.coalesce(round_half_up(F.col("median_note_chars")), F.lit(0)).cast("long"))


def operational(t: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Median hours, resolved and open counts, missed targets, share of tickets in problems of two or more."""
    n = F.count("*")
    row = t.agg(F.count("resolution_hours").alias("resolved"), breach_pct(0).alias("sla_breach_pct"), count_if(~F.col("is_closed")).alias("open_count"), n.alias("_n"))
    row = with_median(row, t, [], F.col("resolution_hours"), "median_hours").withColumn("median_hours", F.round("median_hours", 6))
    recurring = t.groupBy(key).agg(n.alias("k")).filter("k >= 2").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("_r"))
    return row.crossJoin(recurring).withColumn("recurring_pct", whole_pct(F.col("_r"), F.col("_n"))).drop("_n", "_r")


def dim_stats(t: DataFrame) -> DataFrame:
    """Per score dimension: mean, shares of 0 and 100, and four buckets."""
    stack = ", ".join(f"'{d}', score.dims.{d}" for d in config.DIMS)
    long = t.selectExpr(f"stack({len(config.DIMS)}, {stack}) AS (dimension, value)")
    v, n = F.col("value"), F.count("*")
    return long.groupBy("dimension").agg(
        mean1("value").alias("avg"), pct(F.count_if(v == 0), n).alias("zero_pct"), pct(F.count_if(v == 100), n).alias("full_pct"),
        F.count_if(v < 25).alias("below_25"), F.count_if((v >= 25) & (v < 50)).alias("below_50"), F.count_if((v >= 50) & (v < 75)).alias("below_75"), F.count_if(v >= 75).alias("from_75"),
    )


def feedback_counts(t: DataFrame) -> DataFrame:
    """Count of each message and its share of all tickets."""
    total = t.agg(F.count("*").alias("_n"))
    return t.select(F.explode("score.feedback").alias("message")).groupBy("message").agg(F.count("*").alias("n")).crossJoin(total).withColumn("pct", pct(F.col("n"), F.col("_n"))).drop("_n")


def _or(name: str, other: str) -> Column:
    return F.when(F.coalesce(F.col(name), F.lit("")) == "", F.lit(other)).otherwise(F.col(name))


def agent_stats(t: DataFrame, least: int = 2) -> DataFrame:
    """Agents with ``least`` tickets or more."""
    labels = [F.count_if(F.col("score.label") == x).alias(f"n_{x.lower()}") for x in config.LABELS]
    return t.groupBy(_or("assigned_to", "Unassigned").alias("agent")).agg(F.count("*").alias("n"), mean1(TOTAL).alias("avg_score"), *labels).filter(F.col("n") >= least)


def agents_with_label(agents: DataFrame, label: str) -> DataFrame:
    return agents.filter(F.col(f"n_{label.lower()}") > 0)


def group_stats(t: DataFrame) -> DataFrame:
    return t.groupBy(_or("assignment_group", "Unassigned").alias("grp")).agg(
        F.count("*").alias("n"), mean1(TOTAL).alias("avg_score"), F.count_if(F.col("score.label") == "Excellent").alias("n_excellent"), F.count_if(F.col("score.label") == "Critical").alias("n_critical"),
        round_half_up(F.avg("score.noise_ratio") * 100).cast("long").alias("noise_pct"), mean1("score.dims.root_cause").alias("avg_root_cause"), round_half_up(F.avg("score.note_chars")).cast("long").alias("avg_note_chars"),
    )


def bucketed(t: DataFrame, value: Column, names: tuple[str, ...], below: tuple[float, ...]) -> DataFrame:
    """Count of each bucket; ``below`` are the exclusive upper ends of all but the last. Empty buckets stay."""
    which = F.lit(len(below))
    for i in reversed(range(len(below))):
        which = F.when(value < below[i], F.lit(i)).otherwise(which)
    counts = t.select(which.alias("_b")).groupBy("_b").agg(F.count("*").alias("n"))
    axis = t.sparkSession.createDataFrame(list(enumerate(names)), "_b int, bucket string")
    return axis.join(counts, "_b", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def note_length_buckets(t: DataFrame) -> DataFrame:
    return bucketed(t, F.col("score.note_chars"), ("0", "1-50", "51-200", "201-500", "501+"), (1, 51, 201, 501))


def short_description_buckets(t: DataFrame) -> DataFrame:
    return bucketed(t, F.length("short_desc_clean"), ("0", "1-24", "25-60", "61+"), (1, 25, 61))


def noise_buckets(t: DataFrame) -> DataFrame:
    return bucketed(t, F.col("score.noise_ratio"), ("0-20%", "20-50%", "50-80%", "80-100%"), (0.2, 0.5, 0.8))


def distribution(t: DataFrame, column: str) -> DataFrame:
    """Count by state or priority; blank is Unknown."""
    return t.groupBy(_or(column, "Unknown").alias("value")).agg(F.count("*").alias("n"))


def note_length_by_label(t: DataFrame) -> DataFrame:
    axis = t.sparkSession.createDataFrame([(x,) for x in config.LABELS], "label string")
    means = t.groupBy(F.col("score.label").alias("label")).agg(round_half_up(F.avg("score.note_chars")).cast("long").alias("avg_note_chars"))
    return axis.join(means, "label", "left").fillna(0)


def root_cause_by_group(t: DataFrame, least: int = 3, most: int = 15) -> DataFrame:
    """The ``most`` groups of ``least`` tickets or more with the best mean root-cause score; ties by name."""
    return group_stats(t).filter(F.col("n") >= least).select("grp", "n", "avg_root_cause").orderBy(F.desc("avg_root_cause"), "grp").limit(most)


def insights(t: DataFrame) -> DataFrame:
    """(kind, metric, value) of the thresholds that the overview passes."""
    n = F.col("total")
    o = overview(t)
    weakest = dim_stats(t).agg(F.min(F.struct("avg", "dimension")).alias("w"))
    one = o.crossJoin(weakest)
    row = lambda kind, metric, value: F.struct(F.lit(kind).alias("kind"), metric.alias("metric"), value.cast("double").alias("value"))
    poor = F.col("n_poor") + F.col("n_critical")
    rules = [
        F.when(F.col("no_root_cause") / n > 0.3, row("warning", F.lit("no_root_cause_pct"), pct(F.col("no_root_cause"), n))),
        F.when(poor / n > 0.2, row("warning", F.lit("poor_or_critical_pct"), pct(poor, n))),
        F.when(F.col("high_noise") / n > 0.15, row("warning", F.lit("high_noise_pct"), pct(F.col("high_noise"), n))),
        F.when(F.col("w").isNotNull(), row("info", F.concat(F.lit("weakest:"), F.col("w.dimension")), F.col("w.avg"))),
        F.when(F.col("avg_score") < 60, row("warning", F.lit("low_average"), F.col("avg_score"))).when(F.col("avg_score") >= 75, row("positive", F.lit("high_average"), F.col("avg_score"))),
    ]
    return one.filter(n > 0).select(F.explode(F.array_compact(F.array(*rules))).alias("r")).select("r.*")
