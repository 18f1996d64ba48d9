"""Where tickets come from: tables by service, offering and group. Null is the row without a value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketlens.functions.regex import known
from ticketlens.operators.problems import by_name, ranked
from ticketlens.plans.filters import Filters

DIMENSIONS = {"group": "assignment_group", "service": "service", "offering": "service_offering"}


def with_dimensions(t: DataFrame) -> DataFrame:
    return t.withColumns({d: known(F.col(c)) for d, c in DIMENSIONS.items()})


def _candidates(t: DataFrame, key: str, least: int) -> DataFrame:
    return t.groupBy(key).agg(F.count("*").alias("_k")).filter(F.col("_k") >= least).select(key, F.lit(1).alias("_candidate"))


def dimension_table(t: DataFrame, dimension: str, key: str = "cluster_id", least: int = 2) -> DataFrame:
    """Per value: tickets, share of all, distinct known groups, services and offerings, problems among ``least``-ticket ones."""
    rows = with_dimensions(t).join(_candidates(t, key, least), key, "left")
    out = rows.groupBy(F.col(dimension).alias("value")).agg(
        F.count("*").alias("n"), *[F.count_distinct(d).alias(f"distinct_{d}s") for d in DIMENSIONS],
        F.count_distinct(F.when(F.col("_candidate") == 1, F.col(key))).alias("candidates"),
    )
    return out.crossJoin(t.agg(F.count("*").alias("_all"))).withColumn("share", F.round(F.try_divide("n", "_all"), 6)).drop("_all")


def coverage(t: DataFrame, dimension: str) -> DataFrame:
    v = known(F.col(DIMENSIONS[dimension]))
    return t.agg(F.count("*").alias("visible"), F.count(v).alias("with_value"), F.round(F.try_divide(F.count(v), F.count("*")), 6).alias("coverage"))


def table_search(table: DataFrame, text: str) -> DataFrame:
    return table.filter(F.lower("value").contains(text.strip().lower()))


def cross_tab(t: DataFrame, row: str, column: str) -> DataFrame:
    """(level, row_value, column_value, n): cells (level 0), row totals (1), column totals (2), all (3)."""
    d = with_dimensions(t).select(F.col(row).alias("row_value"), F.col(column).alias("column_value"))
    c, r = F.col("column_value"), F.col("row_value")
    return d.groupingSets([[r, c], [r], [c], []], r, c).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n")).select("level", "row_value", "column_value", "n")


def pair_table(t: DataFrame, left: str, right: str, key: str = "cluster_id", least: int = 2) -> DataFrame:
    rows = with_dimensions(t).join(_candidates(t, key, least), key, "left")
    out = rows.groupBy(F.col(left).alias("left_value"), F.col(right).alias("right_value")).agg(F.count("*").alias("n"), F.count_distinct("group").alias("distinct_groups"), F.count_distinct(F.when(F.col("_candidate") == 1, F.col(key))).alias("candidates"))
    out = out.crossJoin(t.agg(F.count("*").alias("_all")))
    return out.select("left_value", "right_value", "n", F.round(F.try_divide("n", "_all"), 6).alias("share"), "distinct_groups", "candidates", (F.col("left_value").isNull() | F.col("right_value").isNull()).alias("is_partial"))


def months_of(t: DataFrame) -> DataFrame:
    return t.select("month").filter("month <> ''").distinct()


def monthly_series(t: DataFrame, dimension: str) -> DataFrame:
    """(value, month, n, month_total, share): every value on every month of the data; share is null in an empty month."""
    d = with_dimensions(t).filter("month <> ''").select(F.col(dimension).alias("value"), "month")
    counts = d.groupBy("value", "month").agg(F.count("*").alias("n"))
    axis = counts.select("value").distinct().crossJoin(F.broadcast(counts.select("month").distinct().withColumnRenamed("month", "_m")))
    full = axis.join(counts.withColumnRenamed("value", "_v"), F.col("value").eqNullSafe(F.col("_v")) & (F.col("month") == F.col("_m")), "left").select("value", F.col("_m").alias("month"), F.coalesce("n", F.lit(0)).alias("n"))
    return full.withColumn("month_total", F.sum("n").over(Window.partitionBy("month"))).withColumn("share", F.round(F.try_divide("n", "month_total"), 6))


def facets(t: DataFrame, filters: Filters, dimension: str) -> DataFrame:
    """(value, n) under all filters but the dimension's own."""
    return t.filter(filters.without(dimension).predicate()).groupBy(F.col(dimension).alias("value")).agg(F.count("*").alias("n"))


def all_facets(t: DataFrame, filters: Filters) -> DataFrame:
    """(dimension, value, n) of month, service and service_offering, each under all filters but its own, from one scan.

    A row that fails no filter counts for every dimension, one that fails a single filter for that filter's dimension only.
    """
    alone = {"month": Filters(months=filters.months), "service": Filters(service=filters.service), "service_offering": Filters(service_offering=filters.service_offering)}
    fails = {d: F.when(F.coalesce(f.predicate(), F.lit(False)), 0).otherwise(1) for d, f in alone.items()}
    marked = t.select(*[F.col(d).alias(f"_v_{d}") for d in alone], *[c.alias(f"_f_{d}") for d, c in fails.items()])
    others = lambda d: sum((F.col(f"_f_{o}") for o in alone if o != d), F.lit(0))
    counted = F.array_compact(F.array(*[F.when(others(d) == 0, F.struct(F.lit(d).alias("dimension"), F.col(f"_v_{d}").alias("value"))) for d in alone]))
    return marked.select(F.explode(counted).alias("c")).groupBy("c.dimension", "c.value").agg(F.count("*").alias("n"))


def members(t: DataFrame, visible: DataFrame, key: str = "cluster_id") -> DataFrame:
    """(key, visible_count, total_count) of every cluster with visible tickets."""
    whole = t.groupBy(key).agg(F.count("*").alias("total_count"))
    return visible.groupBy(key).agg(F.count("*").alias("visible_count")).join(whole, key)


def candidate_context(t: DataFrame, visible: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Per cluster: N of M, known and missing services, distinct counts, and the state of its top service."""
    d = with_dimensions(visible)
    base = d.groupBy(key).agg(F.count("*").alias("visible_count"), F.count("service").alias("known_service"), F.count_if(F.col("service").isNull()).alias("missing_service"), F.count_distinct("service").alias("distinct_services"), F.count_if(F.col("offering").isNull()).alias("missing_offering"), F.count_distinct("group").alias("distinct_groups"))
    counts = d.filter("service IS NOT NULL").groupBy(key, "service").agg(F.count("*").alias("n"))
    leaders = counts.withColumn("_r", F.rank().over(Window.partitionBy(key).orderBy(F.desc("n")))).filter("_r = 1")
    leaders = leaders.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("service")), ",").alias("top_services"), F.max("n").alias("top_count"), F.count("*").alias("_l"))
    out = base.join(t.groupBy(key).agg(F.count("*").alias("total_count")), key).join(leaders, key, "left")
    state = F.when(F.col("_l").isNull(), "NO_KNOWN_SERVICE").when(F.col("_l") > 1, "TIE").otherwise("SINGLE")
    return out.withColumn("top_state", state).withColumn("top_share", F.round(F.try_divide("top_count", "known_service"), 6)).drop("_l")


def top_with_others(table: DataFrame, most: int) -> DataFrame:
    """(segment, value, entries, n): the largest known values, one row for the others, one for no value."""
    r = ranked(table.filter("value IS NOT NULL").select("value", "n"), [], F.desc("n"), by_name("value"))
    shown = F.col("rank") <= most
    top = r.groupBy(F.when(shown, F.lit("top")).otherwise(F.lit("others")).alias("segment"), F.when(shown, F.col("value")).alias("value")).agg(F.count("*").alias("entries"), F.sum("n").alias("n"))
    return top.union(table.filter("value IS NULL").select(F.lit("missing"), "value", F.lit(1).cast("long"), F.col("n")))


def service_ranking(t: DataFrame, key: str, most: int) -> DataFrame:
    """(place, kind, value, n, share): the largest services, one row for the others, one for no service, with shares of all tickets."""
    table = dimension_table(t, "service", key)
    total = table.agg(F.sum("n").alias("_t"))
    r = ranked(table.filter("value IS NOT NULL").select("value", "n"), [], F.desc("n"), by_name("value"))
    top = r.groupBy(F.least("rank", F.lit(most + 1)).alias("place")).agg(F.max(F.when(F.col("rank") <= most, "service").otherwise("others")).alias("kind"), F.max(F.when(F.col("rank") <= most, F.col("value"))).alias("value"), F.sum("n").alias("n"))
    rows = top.union(table.filter("value IS NULL").select(F.lit(most + 2), F.lit("missing"), "value", "n"))
    return rows.crossJoin(total).select("place", "kind", "value", "n", F.round(F.try_divide("n", "_t"), 6).alias("share"))


def expanded_row(t: DataFrame, row: str, column: str, value: str | None) -> DataFrame:
    """(value, n): the column margin of one row of a cross table."""
    d = with_dimensions(t)
    return d.filter(F.col(row).eqNullSafe(F.lit(value))).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def capped_matrix(t: DataFrame, row: str, column: str, rows: int = 15, columns: int = 8) -> DataFrame:
    """(row_value, column_value, n): a cross table of the largest values, the rest as Others, null as (none)."""

    def axis(dimension: str, most: int, out: str) -> DataFrame:
        counts = with_dimensions(t).groupBy(F.col(dimension).alias("value")).agg(F.count("*").alias("n")).filter("value IS NOT NULL")
        return ranked(counts, [], F.desc("n"), by_name("value")).filter(F.col("rank") <= most).select(F.col("value").alias(dimension), F.col("value").alias(out))

    d = with_dimensions(t).select(F.col(row), F.col(column))
    d = d.join(axis(row, rows, "_r"), row, "left").join(axis(column, columns, "_c"), column, "left")
    name = lambda c, x: F.when(F.col(c).isNull(), "(none)").otherwise(F.coalesce(x, F.lit("Others")))
    return d.groupBy(name(row, "_r").alias("row_value"), name(column, "_c").alias("column_value")).agg(F.count("*").alias("n"))


def page(table: DataFrame, number: int, size: int = 25) -> DataFrame:
    """A page (from 0) of a dimension table by rank; a table has a row for each value."""
    r = ranked(table, [], F.col("value").isNull(), F.desc("n"), by_name("value"))
    return r.filter(F.col("rank").between(number * size + 1, (number + 1) * size))
