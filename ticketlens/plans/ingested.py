"""The tickets of the given tables written as CSV, the way two ticket systems export them, and read back through the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens import config
from ticketlens.plans.shared import scratch
from ticketlens.sources.tickets import canonical, column_kinds, drop_email_columns, read_csv, typed
from ticketlens.sources.view import incidents

TEXTS = ("number", "task_type", "priority", "state", "short_description", "description", "work_notes", "assignment_group", "assigned_to", "channel")
#: What ISO-8859-1 and windows-1252 write alike.
LATIN = r"^[\x00-\x7e\xa0-\xff]*$"


def _exported(rows: DataFrame, which: int, date: str, yes: str, no: str) -> list[Column]:
    """Canonical columns under the system's own headers (the first or the last alias), dates and flags as it writes them."""
    header = {c: names[-which] for c, names in {**config.SOURCE_COLUMNS, **config.DIMENSION_COLUMNS}.items()}
    moment = lambda c: F.coalesce(F.date_format(F.try_to_timestamp(F.nullif(F.col(c), F.lit(""))), date), F.lit(""))
    made = {**{c: F.col(c) for c in (*TEXTS, "service", "service_offering")}, "opened": moment("opened"), "closed": moment("closed"), "made_sla": F.when(F.col("made_sla"), yes).when(~F.col("made_sla"), no).otherwise("")}
    extra = {"Due": F.substring("opened", 1, 10), "Cost": F.concat((F.col("row_id") * 3).cast("string"), F.lit(".25")), "Order ID": F.col("row_id").cast("string"), "caller.email": F.lit("a@b.c")}
    return [*[c.alias(header[name]) for name, c in made.items()], *[c.alias(name) for name, c in extra.items()]]


def exports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two raw tables: one exported in UTF-8 with display names and ISO dates, one in an eight-bit encoding with field names and day/month dates."""
    rows = incidents(spark, sf_dir)
    plain = F.concat_ws("", *TEXTS, "service", "service_offering").rlike(LATIN) & (F.col("row_id") % 2 == 1)
    base = scratch(spark, "csv")
    for name, part, columns, encoding in (
        ("display", rows.filter(~plain), _exported(rows, 0, "yyyy-MM-dd HH:mm:ss", "true", "false"), "UTF-8"),
        ("field", rows.filter(plain), _exported(rows, 1, "dd/MM/yyyy HH:mm:ss", "Sí", "no"), "ISO-8859-1"),
    ):
        part.select(*columns).write.csv(f"{base}/{name}", header=True, quoteAll=True, escape='"', encoding=encoding, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    read = lambda name: drop_email_columns(read_csv(spark, f"{base}/{name}/*.csv"))
    return read("display"), read("field")


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tickets as the sources give them: canonical columns, known dimensions, typed other columns."""
    out = None
    for raw in exports(spark, sf_dir):
        kinds = {c: k for c, k in column_kinds(raw).items() if c in ("Due", "Cost", "Order ID")}
        whole = typed(canonical(raw, F.monotonically_increasing_id()), kinds)
        whole = whole.select(*config.SOURCE_COLUMNS, *config.DIMENSION_COLUMNS, F.date_format("Due", "yyyy-MM-dd").alias("due"), F.col("Cost").alias("cost"), F.col("Order ID").alias("order_id"))
        out = whole if out is None else out.union(whole)
    return out


def ingested_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(export, column_name, kind) of the columns that are not canonical."""
    rows = [(name, c, kind) for name, raw in zip(("display", "field"), exports(spark, sf_dir), strict=True) for c, kind in column_kinds(raw).items()]
    return spark.createDataFrame(rows, "export string, column_name string, kind string")
