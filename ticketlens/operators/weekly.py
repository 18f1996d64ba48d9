"""Weekly review against the weeks with data just before, for one week or for all of them at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketlens.functions.dates import timestamp, week_start
from ticketlens.functions.regex import round_half_up
from ticketlens.operators.overview import mean1
from ticketlens.operators.problems import by_name, problem_table, ranked, recommend

BASELINE_WEEKS = 4
MOVEMENT_PCT = 25
MOVEMENT_COUNT = 3


def available_weeks(t: DataFrame) -> DataFrame:
    return t.select("week").filter("week <> ''").distinct()


def baselines(t: DataFrame, most: int = BASELINE_WEEKS) -> DataFrame:
    """(week, base_week) for up to ``most`` earlier weeks with data. One row a week goes through the window."""
    w = Window.orderBy("week").rowsBetween(-most, -1)
    return available_weeks(t).withColumn("base", F.collect_list("week").over(w)).select("week", F.explode("base").alias("base_week"))


def volumes(t: DataFrame) -> DataFrame:
    """(week, n, baseline, delta_pct): tickets against the mean of the baseline weeks, 0 without one."""
    return volumes_of(t.filter("week <> ''").groupBy("week").agg(F.count("*").alias("n")))


def volumes_of(n: DataFrame) -> DataFrame:
    """``volumes`` from (week, n)."""
    base = F.coalesce(F.avg("n").over(Window.orderBy("week").rowsBetween(-BASELINE_WEEKS, -1)), F.lit(0.0))
    out = n.withColumn("_b", base)
    return out.select("week", "n", round_half_up(F.col("_b"), 1).alias("baseline"), F.when(F.col("_b") > 0, round_half_up((F.col("n") - F.col("_b")) / F.col("_b") * 100)).otherwise(0).cast("long").alias("delta_pct"))


def _value_history(t: DataFrame, value: Column) -> DataFrame:
    """(week, value, n, typical, base_weeks): counts of values in a week and in its baseline weeks, zeros included."""
    return value_history(t.filter("week <> ''").select("week", value.alias("value")).groupBy("week", "value").agg(F.count("*").alias("n")))


def value_history(counts: DataFrame) -> DataFrame:
    """The same from (week, value, n), which has a row for every week with tickets."""
    base = baselines(counts)
    spans = available_weeks(counts).join(base.groupBy("week").agg(F.count("*").alias("base_weeks")), "week", "left").fillna(0, ["base_weeks"])
    before = base.join(counts.select(F.col("week").alias("base_week"), "value", F.col("n").alias("_n")), "base_week").groupBy("week", "value").agg(F.sum("_n").alias("_before"))
    both = counts.select("week", "value", "n", F.lit(0).cast("long").alias("_before")).union(before.select("week", "value", F.lit(0).cast("long"), "_before"))
    out = both.groupBy("week", "value").agg(F.sum("n").alias("n"), F.sum("_before").alias("_before")).join(spans, "week")
    return out.withColumn("typical", F.col("_before") / F.greatest("base_weeks", F.lit(1))).drop("_before")


def movements(t: DataFrame, most: int = 6) -> DataFrame:
    """Categories that moved: 3 tickets and 25 % or more, the largest changes first, ``most`` a week."""
    return moved(_value_history(t, F.col("category")), most)


def moved(history: DataFrame, most: int = 6) -> DataFrame:
    """``movements`` from the history of categories."""
    h = history.filter(F.col("n") >= MOVEMENT_COUNT)
    h = h.withColumn("delta_pct", F.when(F.col("typical") > 0, round_half_up((F.col("n") - F.col("typical")) / F.col("typical") * 100)).otherwise(100).cast("long"))
    h = h.filter(F.abs("delta_pct") >= MOVEMENT_PCT).withColumn("change", F.col("n") - F.col("typical"))
    top = ranked(h, ["week"], F.abs("change").desc(), F.desc("n"), by_name("value")).filter(F.col("rank") <= most)
    return top.select("week", "rank", F.col("value").alias("name"), "n", round_half_up(F.col("typical"), 1).alias("baseline"), F.round("change", 6).alias("change"), "delta_pct", F.when(F.col("delta_pct") >= 0, "up").otherwise("down").alias("direction"))


def _week_clusters(t: DataFrame, key: str) -> DataFrame:
    """(week, key, n, title_row...) of every problem in every week, and whether its baseline weeks had it."""
    now = t.filter("week <> ''").groupBy("week", key).agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))
    seen = baselines(t).join(t.select(F.col("week").alias("base_week"), key).distinct(), "base_week").select("week", key).distinct().withColumn("known", F.lit(True))
    return now.join(seen, ["week", key], "left").fillna(False, ["known"])


def week_problems(t: DataFrame, key: str = "cluster_id", most: int = 8) -> DataFrame:
    """(week, kind, rank, key, n, weeks_active, is_chronic): new and recurring problems of every week.

    New: not in the baseline weeks, two tickets or more. Recurring: in them; weeks and chronic state
    are those of the whole file, where the problem has two tickets or more there.
    """
    clusters = _week_clusters(t, key)
    whole = problem_table(t, key).select(key, "weeks_active", "is_chronic")
    rows = clusters.filter("known OR n >= 2").withColumn("kind", F.when(F.col("known"), "recurring").otherwise("new"))
    top = ranked(rows, ["week", "kind"], F.desc("n"), F.col(key)).filter(F.col("rank") <= most).join(whole, key, "left")
    mine = F.col("kind") == "recurring"
    return top.select("week", "kind", "rank", key, "n", F.when(mine, F.coalesce("weeks_active", F.lit(1))).otherwise(F.lit(1)).alias("weeks_active"), F.when(mine, F.coalesce("is_chronic", F.lit(False))).otherwise(F.lit(False)).alias("is_chronic"))


def top_problems(t: DataFrame, key: str = "cluster_id", most: int = 10) -> DataFrame:
    rows = t.filter("week <> ''").groupBy("week", key).agg(F.count("*").alias("n")).filter("n >= 2")
    return ranked(rows, ["week"], F.desc("n"), F.col(key)).filter(F.col("rank") <= most).select("week", "rank", key, "n")


def digest(t: DataFrame, week: str, key: str = "cluster_id") -> dict[str, DataFrame]:
    """All parts of one week's review."""
    one = F.col("week") == week
    now = t.filter(one)
    kinds = week_problems(t, key).filter(one)
    return {
        "volume": volumes(t).filter(one), "movements": movements(t).filter(one), "new": kinds.filter("kind = 'new'"),
        "recurring": kinds.filter("kind = 'recurring'"), "top": top_problems(t, key).filter(one), "actions": recommend(now, key).orderBy("priority", F.desc("n"), key).limit(6),
    }


def digest_table(t: DataFrame, week: str, key: str = "cluster_id") -> DataFrame:
    """(section, rank, name, n, detail): one week's whole review as one table, a section after the other."""
    return as_table(digest(t, week, key), key)


def as_table(d: dict[str, DataFrame], key: str) -> DataFrame:
    """The parts of a review as one table."""
    name, text = F.col(key).cast("string").alias("name"), lambda c: F.col(c).cast("string").alias("detail")
    rows = [
        d["volume"].select(F.lit("volume").alias("section"), F.lit(1).alias("rank"), F.col("week").alias("name"), "n", text("delta_pct")),
        d["movements"].select(F.lit("movements"), "rank", "name", "n", text("delta_pct")),
        d["new"].select(F.lit("new"), "rank", name, "n", text("weeks_active")),
        d["recurring"].select(F.lit("recurring"), "rank", name, "n", text("weeks_active")),
        d["top"].select(F.lit("top"), "rank", name, "n", F.lit(None).cast("string").alias("detail")),
        d["actions"].select(F.lit("actions"), F.row_number().over(Window.orderBy("priority", F.desc("n"), key)), name, "n", F.col("kind").alias("detail")),
    ]
    return reduce(DataFrame.union, rows)


def bridge(t: DataFrame, dimension: str) -> DataFrame:
    """(week, value, n, typical, change): the value that moved most, ties by count, then value; none without a baseline or change."""
    h = _value_history(t, F.coalesce(F.col(dimension), F.lit(""))).filter("base_weeks > 0").withColumn("change", F.col("n") - F.col("typical")).filter("change <> 0")
    top = ranked(h, ["week"], F.abs("change").desc(), F.desc("n"), by_name("value")).filter("rank = 1")
    return top.select("week", F.nullif(F.col("value"), F.lit("")).alias("value"), "n", F.round("typical", 6).alias("typical"), F.round("change", 6).alias("change"))


def data_through(t: DataFrame) -> DataFrame:
    return t.agg(F.date_format(F.max(timestamp(F.col("opened"))), "yyyy-MM-dd HH:mm:ss").alias("through"))


def comparable(t: DataFrame) -> DataFrame:
    """(week, comparable): weeks whose Sunday the data reach."""
    last = t.agg(F.max(timestamp(F.col("opened"))).alias("_t"))
    return available_weeks(t).crossJoin(last).select("week", (F.to_date("_t") >= F.date_add(week_start(F.col("week")), 6)).alias("comparable"))


def calendar_weeks(t: DataFrame) -> DataFrame:
    """Every ISO week between the first and the last with data."""
    ends = t.filter("week <> ''").agg(F.min(week_start(F.col("week"))).alias("a"), F.max(week_start(F.col("week"))).alias("b")).filter("a IS NOT NULL")
    days = ends.select(F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("monday"))
    return days.select(F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), "monday"), F.weekofyear("monday")).alias("week"))


def weeks_of_months(t: DataFrame, months: list[str]) -> DataFrame:
    """Calendar weeks of which a day lies in one of the months."""
    start = week_start(F.col("week"))
    days = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.date_format(F.date_add(start, i), "yyyy-MM"))
    return calendar_weeks(t).filter(F.arrays_overlap(days, F.array(*[F.lit(m) for m in months]).cast("array<string>")))


def composition_dimension(t: DataFrame, available: tuple[str, ...] = ("service", "service_offering", "assignment_group")) -> DataFrame:
    """(kind, dimension, single_service, single_missing): which dimension a weekly stack is drawn by.

    A: services vary. B or C: offerings vary, with one service or none. D: groups vary. Else no dimension, B or E.
    """
    known = lambda c: F.nullif(F.col(c), F.lit("")) if c in available else F.lit(None).cast("string")
    row = t.agg(*[F.count_distinct(known(c)).alias(n) for c, n in (("service", "s"), ("service_offering", "o"), ("assignment_group", "g"))], F.max(known("service")).alias("one"), F.count_if(known("service").isNull()).alias("none"))
    s, single = F.col("s"), F.col("s") == 1
    kind = F.when(s >= 2, "A").when(F.col("o") >= 2, F.when(single, "B").otherwise("C")).when(F.col("g") >= 2, "D").when(single, "B").otherwise("E")
    dimension = F.when(s >= 2, "service").when(F.col("o") >= 2, "service_offering").when(F.col("g") >= 2, "assignment_group")
    return row.select(kind.alias("kind"), dimension.alias("dimension"), F.when(single, F.col("one")).alias("single_service"), F.when(single, F.col("none")).alias("single_missing"))


def composition(t: DataFrame, dimension: str, most: int = 5) -> DataFrame:
    """(week, segment, n) of the calendar weeks: the window's largest values, others, missing; sums to the week's total."""
    d = t.filter("week <> ''").select("week", F.nullif(F.col(dimension), F.lit("")).alias("value"))
    counts = d.groupBy("value").agg(F.count("*").alias("n")).filter("value IS NOT NULL")
    top = ranked(counts, [], F.desc("n"), by_name("value")).filter(F.col("rank") <= most).select("value", F.col("value").alias("_top"))
    segment = F.when(F.col("value").isNull(), "missing").otherwise(F.coalesce(F.concat(F.lit("value:"), "_top"), F.lit("others")))
    return d.join(top, "value", "left").groupBy("week", segment.alias("segment")).agg(F.count("*").alias("n"))


def scores_by_week(t: DataFrame) -> DataFrame:
    return t.filter("week <> ''").groupBy("week").agg(mean1("score.total").alias("avg_score"))
