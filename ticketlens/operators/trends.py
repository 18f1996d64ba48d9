"""Period trends: ISO weeks and months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketlens import config
from ticketlens.functions.regex import round_half_up, whole_pct
from ticketlens.operators.medians import with_median
from ticketlens.operators.overview import breach_pct, mean1


def period_trends(t: DataFrame, period: str = "week") -> DataFrame:
    """One row for each week or month with tickets; undated tickets are left out."""
    n = F.count("*")
    dims = [mean1(f"score.dims.{d}").alias(f"avg_{d}") for d in config.DIMS]
    rows = t.filter(F.col(period) != "").withColumn("period", F.col(period))
    out = rows.groupBy("period").agg(
        n.alias("n"), mean1("score.total").alias("avg_score"), *dims,
        whole_pct(F.count_if(F.col("score.label") == "Excellent"), n).alias("excellent_pct"),
        whole_pct(F.count_if(F.col("score.label").isin("Poor", "Critical")), n).alias("poor_pct"),
        whole_pct(F.count_if(F.col("score.dims.root_cause") == 0), n).alias("no_root_cause_pct"),
        whole_pct(F.count_if(F.col("score.noise_ratio") > 0.5), n).alias("noise_pct"),
        breach_pct(0).alias("sla_breach_pct"),
        whole_pct(F.count_if(F.col("root_cause_text") != ""), n).alias("rca_pct"),
        F.count_if(~F.col("is_closed")).alias("open_count"),
    )
    return with_median(out, rows, ["period"], F.col("resolution_hours"), "median_hours").withColumn("median_hours", round_half_up(F.col("median_hours"), 1))


def trend_deltas(trends: DataFrame) -> DataFrame:
    """Last minus first period of score, root cause and noise; no row below two periods."""
    ends = {c: (F.min_by(c, "period"), F.max_by(c, "period")) for c in ("avg_score", "avg_root_cause", "noise_pct")}
    out = trends.agg(F.count("*").alias("periods"), F.min("period").alias("first_period"), F.max("period").alias("last_period"), *[F.round(b - a, 6).alias(f"{c}_delta") for c, (a, b) in ends.items()])
    return out.filter("periods >= 2").drop("periods")


#: A table of periods has a row for each week or month of the data, so one window over all of them is small.
def with_previous(trends: DataFrame) -> DataFrame:
    """Each period with its previous one that has data, and the changes of score and missed targets."""
    w = Window.orderBy("period")
    out = trends.select("period", "n", "avg_score", "sla_breach_pct", F.lag("period").over(w).alias("previous"), F.lag("avg_score").over(w).alias("_s"), F.lag("sla_breach_pct").over(w).alias("_b"))
    return out.select("period", "n", "previous", F.round(F.col("avg_score") - F.col("_s"), 6).alias("score_delta"), (F.col("sla_breach_pct") - F.col("_b")).alias("sla_delta"))


def history(trends: DataFrame, period: str, most: int = 12) -> DataFrame:
    """The last ``most`` periods up to one."""
    return trends.filter(F.col("period") <= period).orderBy(F.desc("period")).limit(most)
