"""Weekly volumes of a stream of canonical tickets: event-time windows of ISO weeks with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.dates import timestamp
from ticketlens.functions.text import category, clean_text


def weekly_volumes(tickets: DataFrame, late: str = "14 days") -> DataFrame:
    """(week, category, n) of a stream with columns opened, short_description, description.

    Windows run from Monday to Monday; a week is final when the watermark, ``late`` behind the newest
    ticket, has passed its end. Tickets without a readable date are left out.
    """
    rows = tickets.select(timestamp(F.col("opened")).alias("opened_ts"), category(clean_text(F.col("short_description")), clean_text(F.col("description"))).alias("category"))
    counts = rows.filter("opened_ts IS NOT NULL").withWatermark("opened_ts", late).groupBy(F.window("opened_ts", "7 days", startTime="4 days"), "category").agg(F.count("*").alias("n"))
    start = F.col("window.start")
    return counts.select(F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), start), F.weekofyear(start)).alias("week"), "category", "n")
