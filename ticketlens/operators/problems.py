"""Recurring problems: tickets rolled up by a cluster or category key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketlens import config
from ticketlens.functions.regex import pct
from ticketlens.functions.text import normalized_key, truncate
from ticketlens.operators.medians import with_median
from ticketlens.operators.overview import _or, breach_pct, count_if, mean1


def ranked(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def by_name(c: str) -> Column:
    """Names in the order of a language's dictionary, as people read them."""
    return F.collate(F.col(c), "UNICODE")


def top_counts(t: DataFrame, key: str, value: Column, most: int) -> DataFrame:
    """(key, name, n, rank): the most frequent non-blank values of each key, ties by name.

    Values are counted before they are ranked, so a key's task sees its distinct values only.
    """
    counts = t.select(key, value.alias("name")).filter("name IS NOT NULL AND name <> ''").groupBy(key, "name").agg(F.count("*").alias("n"))
    return ranked(counts, [key], F.desc("n"), by_name("name")).filter(F.col("rank") <= most)


def causes(t: DataFrame, key: str) -> DataFrame:
    """(key, cause_key, cause, n, first_row): written root causes of each key; the first wording stands for its like."""
    keyed = t.filter("root_cause_text <> ''").select(key, "row_id", "root_cause_text", F.coalesce(F.nullif(normalized_key(F.col("root_cause_text")), F.lit("")), F.lower("root_cause_text")).alias("cause_key"))
    return keyed.groupBy(key, "cause_key").agg(F.min_by("root_cause_text", "row_id").alias("cause"), F.count("*").alias("n"), F.min("row_id").alias("first_row"))


def top_causes(t: DataFrame, key: str, most: int = 5) -> DataFrame:
    """(key, rank, cause, n, pct): ties by the row that wrote it first; pct of the key's tickets."""
    sizes = t.groupBy(key).agg(F.count("*").alias("_n"))
    top = ranked(causes(t, key), [key], F.desc("n"), F.col("first_row")).filter(F.col("rank") <= most)
    return top.join(sizes, key).select(key, "rank", "cause", "n", pct(F.col("n"), F.col("_n")).alias("pct"))


def sample_numbers(t: DataFrame, key: str, most: int = 25) -> DataFrame:
    """(key, rank, number): the first tickets of each key in row order."""
    return ranked(t.select(key, "row_id", "number"), [key], F.col("row_id")).filter(F.col("rank") <= most).select(key, "rank", "number")


def problem_table(t: DataFrame, key: str = "cluster_id", least: int = 2) -> DataFrame:
    """One flat row for each key with ``least`` tickets or more."""
    n = F.count("*")
    opened, weeks = F.nullif(F.col("opened"), F.lit("")), F.count_distinct(F.nullif(F.col("week"), F.lit("")))
    documented = count_if(F.col("root_cause_text") != "")
    total = t.agg(n.alias("_total"))
    flat = t.groupBy(key).agg(
        n.alias("n"), weeks.alias("weeks_active"), F.coalesce(F.min(opened), F.lit("")).alias("first_seen"), F.coalesce(F.max(opened), F.lit("")).alias("last_seen"),
        documented.alias("documented"), pct(documented, n).alias("rca_coverage"), breach_pct().alias("sla_breach_pct"),
        mean1("score.total").alias("avg_score"), *([] if key == "category" else [F.min_by("category", "row_id").alias("category")]), F.min_by("short_desc_clean", "row_id").alias("_first"),
    ).filter(F.col("n") >= least)
    flat = with_median(flat, t, [key], F.col("resolution_hours"), "median_hours")
    title = top_counts(t, key, F.col("short_desc_clean"), 1).select(key, F.col("name").alias("_name"))
    out = flat.join(title, key, "left").crossJoin(total)
    name = F.coalesce("_name", F.nullif(F.col("_first"), F.lit("")), F.lit("(no short description)"))
    chronic = (F.col("weeks_active") >= config.CHRONIC) & (F.col("n") >= config.CHRONIC)
    return out.withColumns({"title": truncate(name, 110), "share": pct(F.col("n"), F.col("_total")), "is_chronic": chronic}).drop("_name", "_first", "_total")


def problems(t: DataFrame, key: str = "cluster_id", least: int = 2) -> DataFrame:
    """``problem_table`` with its lists: root causes, top groups and agents, first numbers."""
    out = problem_table(t, key, least)
    nest = lambda df, name, *cols: df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", *cols))), lambda x: F.struct(*[x[c].alias(c) for c in cols]) if len(cols) > 1 else x[cols[0]]).alias(name))
    parts = [
        nest(top_causes(t, key), "root_causes", "cause", "n", "pct"),
        nest(top_counts(t, key, _or("assignment_group", "Unassigned"), 3), "top_groups", "name", "n"),
        nest(top_counts(t, key, _or("assigned_to", "Unassigned"), 3), "top_agents", "name", "n"),
        nest(sample_numbers(t, key), "sample_numbers", "number"),
    ]
    for p in parts:
        out = out.join(p, key, "left")
    return out


def category_stats(t: DataFrame, key: str = "cluster_id") -> DataFrame:
    n, documented = F.count("*"), count_if(F.col("root_cause_text") != "")
    total = t.agg(n.alias("_total"))
    rows = t.groupBy("category").agg(n.alias("n"), F.count_distinct(key).alias("distinct_problems"), pct(documented, n).alias("rca_coverage"), breach_pct().alias("sla_breach_pct"), mean1("score.total").alias("avg_score"))
    rows = with_median(rows, t, ["category"], F.col("resolution_hours"), "median_hours").withColumn("median_hours", F.round("median_hours", 6))
    return rows.crossJoin(total).withColumn("share", pct(F.col("n"), F.col("_total"))).drop("_total")


def recommend(t: DataFrame, key: str = "cluster_id") -> DataFrame:
    """(key, kind, n, priority): the first rule that fits a problem of max(3, 1 % of all tickets) or more."""
    floor = t.agg(F.greatest(F.lit(3), F.floor(F.count("*") * 0.01 + 0.5)).alias("_floor"))
    top = top_causes(t, key).groupBy(key).agg(F.count("*").alias("_causes"), F.min_by("pct", "rank").alias("_top"))
    p = problem_table(t, key).join(top, key, "left").crossJoin(floor).filter("n >= _floor")
    kind = (
        F.when(F.col("rca_coverage") < 50, "problem-management").when(F.col("median_hours") <= 2, "automation")
        .when((F.col("_causes") >= 3) & (F.col("_top") < 40), "knowledge-gap").when(F.col("is_chronic"), "chronic")
    )
    order = F.element_at(F.create_map(*[F.lit(x) for x in ("problem-management", 0, "chronic", 1, "automation", 2, "knowledge-gap", 3)]), F.col("kind"))
    return p.withColumn("kind", kind).filter("kind IS NOT NULL").select(key, "kind", "n", order.alias("priority"))


def problem_totals(p: DataFrame) -> DataFrame:
    """Of a problem table: problems, their tickets, chronic ones, documented share, share of the ten largest."""
    top = p.orderBy(F.desc("n"), by_name("title")).limit(10).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_top"))
    row = p.agg(F.count("*").alias("distinct_problems"), F.coalesce(F.sum("n"), F.lit(0)).alias("recurring"), count_if(F.col("is_chronic")).alias("chronic"), F.coalesce(F.sum("documented"), F.lit(0)).alias("_d"))
    return row.crossJoin(top).select("distinct_problems", "recurring", "chronic", pct(F.col("_d"), F.col("recurring")).alias("documented_pct"), pct(F.col("_top"), F.col("recurring")).alias("top10_pct"))


def visible(p: DataFrame, category: str | None = None, undocumented: bool = False, search: str = "") -> DataFrame:
    """Problem list filter: category, less than half documented, text in title or category."""
    keep = F.lit(True)
    if category:
        keep &= F.col("category") == category
    if undocumented:
        keep &= F.col("rca_coverage") < 50
    if search.strip():
        s = search.strip().lower()
        keep &= F.lower("title").contains(s) | F.lower("category").contains(s)
    return p.filter(keep)
