"""Incidents from the star-schema tables: one for each document, with events, orders, labels and talks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.functions.dates import month_key, resolution_hours, week_key
from ticketlens.functions.regex import known
from ticketlens.functions.score import combined_text, marks, ticket_score
from ticketlens.functions.text import category, root_cause, signature, tokens
from ticketlens.sources.tickets import enriched

#: Texts of the view, fixed by the test data's description: short text and first note by doc_id modulo 8.
TEMPLATES = (
    ("VPN tunnel drops for remote sites", "The cause was traced to an expired tunnel key. Key rotated and verified."),
    ("Remote sites lose VPN tunnel again", "Restarted the gateway and confirmed with the site."),
    ("Password expired and account locked out", "Root cause: old password cached on a phone. Reset done."),
    ("Mailbox stops syncing after maintenance", "Found that the mail cache was corrupt. Cache rebuilt."),
    ("Printer offline, jobs stay queued", "Please check"),
    ("Disk space full on report server", "Due to missing log rotation. Enabled rotation."),
    ("Database deadlock during nightly batch", "wip"),
    ("TLS certificate expired on portal", "Se identificó que el certificado caducó. Se aplicó la renovación."),
)


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id and the canonical columns; joins are on document, event, order, label and conversation ids."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    minutes = lambda m: F.make_dt_interval(F.lit(0), F.lit(0), m.cast("int"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    docs = read("documents").select("doc_id", "text", "lang", "source")
    events = read("events").select(F.col("event_id").alias("doc_id"), "user_id", "event_type", "value", "ts")
    orders = read("orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus", "o_orderpriority")
    labels = read("labels").select("doc_id", "quality")
    base = docs.join(events, "doc_id").join(orders, "doc_id").join(labels, "doc_id", "left")
    base = base.withColumn("opened_ts", F.col("ts") + F.make_dt_interval((F.col("doc_id") % 13 * 7).cast("int")))
    # a talk has a few turns, so its rows can be put together by its id
    turns = read("conversations").join(base.select(F.col("doc_id").alias("conv_id"), "opened_ts"), "conv_id")
    line = F.concat(stamp(F.col("opened_ts") + minutes(F.col("turn") * 10 + 5)), F.lit(" - "), "role", F.lit(" (Work notes)\n"), "text")
    journal = turns.select("conv_id", "turn", line.alias("line")).groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n\n").alias("journal"))
    base = base.join(journal, "doc_id", "left")
    which = (F.col("doc_id") % 8).cast("int")
    short_text, note_text = (F.get(F.array(*[F.lit(t[i]) for t in TEMPLATES]), which) for i in (0, 1))
    user = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    first = F.concat(stamp(F.col("opened_ts") + minutes(F.lit(1))), F.lit(" - System (Work notes)\nTask is created by system\n\n"), stamp(F.col("opened_ts") + minutes(F.lit(3))), F.lit(" - "), user, F.lit(" (Work notes)\n"), note_text)
    return base.select(
        F.col("doc_id").alias("row_id"),
        F.concat(F.lit("INC"), F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("number"),
        F.lit("Incident").alias("task_type"),
        F.col("o_orderpriority").alias("priority"),
        F.when(F.col("o_orderstatus") == "F", "Closed").when(F.col("o_orderstatus") == "P", "Resolved").otherwise("New").alias("state"),
        F.when(F.col("doc_id") % 10 == 9, F.substring_index("text", "\n", 1)).otherwise(F.concat(short_text, F.lit(" INC"), F.col("doc_id").cast("string"))).alias("short_description"),
        F.col("text").alias("description"),
        F.concat(first, F.coalesce(F.concat(F.lit("\n\n"), "journal"), F.lit(""))).alias("work_notes"),
        F.col("source").alias("assignment_group"),
        user.alias("assigned_to"),
        stamp(F.col("opened_ts")).alias("opened"),
        F.when(F.col("o_orderstatus") == "O", "").otherwise(stamp(F.col("opened_ts") + minutes(F.floor("value")))).alias("closed"),
        F.col("event_type").alias("channel"),
        (F.col("quality") == 1).alias("made_sla"),
        F.when(F.col("doc_id") % 20 == 19, "").otherwise(F.col("lang")).alias("service"),
        F.when(F.col("doc_id") % 15 == 14, "").otherwise(F.concat(F.lit("offering_"), (F.col("doc_id") % 9).cast("string"))).alias("service_offering"),
    )


def annotated(rows: DataFrame) -> DataFrame:
    """Canonical rows with notes, score, category, root cause, hours, week, month, closed flag and tokens.

    The score is a struct on the row itself, so rows with one number keep a score each. Optional
    dimensions are trimmed, blank is null.
    """
    out = enriched(rows).withColumn("_combined", combined_text(F.col("desc_clean"), F.col("human_notes")))
    out = out.withColumn("_lowered", F.lower("_combined"))
    out = out.withColumn("_marks", marks(F.col("_combined"), F.col("_lowered")))
    state = F.lower("state")
    return out.withColumns(
        {
            "score": ticket_score(F.col("short_desc_clean"), F.col("desc_clean"), F.col("is_auto_desc"), F.col("state"), F.col("human_notes"), F.col("_lowered"), F.col("_marks")),
            "category": category(F.col("short_desc_clean"), F.col("desc_clean")),
            "root_cause_text": root_cause(F.col("_combined"), F.col("_marks.cause")),
            "resolution_hours": resolution_hours(F.col("opened"), F.col("closed")),
            "week": week_key(F.col("opened")),
            "month": month_key(F.col("opened")),
            "is_closed": state.contains("closed") | state.contains("resolved"),
            "tokens": tokens(signature(F.col("short_desc_clean"), F.col("desc_clean"))),
            "service": known(F.col("service")),
            "service_offering": known(F.col("service_offering")),
        }
    ).drop("_combined", "_lowered", "_marks")


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotated(incidents(spark, sf_dir))
