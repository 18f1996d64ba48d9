"""Export tables: problems, their tickets, and what was exported."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens import config
from ticketlens.functions.dates import duration_text
from ticketlens.functions.regex import trim
from ticketlens.operators.problems import problems



def fit(c: Column, most: int = config.CELL_LIMIT) -> Column:
    """A text that fits a spreadsheet's cell; a longer one ends in a mark with its length."""
    mark = F.concat(F.lit("\n…[TRUNCADO: el valor original tiene "), F.length(c).cast("string"), F.lit(f" caracteres; Excel admite {most}]"))
    return F.when(F.length(c) > most, F.concat(F.substring(c, F.lit(1), F.lit(most) - F.length(mark)), mark)).otherwise(c)


#: The shape of ISO date text, and the days from a spreadsheet's day 0 (1899-12-30) to 1970.
ISO_DATE = r"^(\d{4})-(\d{2})-(\d{2})(?: (\d{2}):(\d{2})(?::(\d{2}))?)?$"
SERIAL_OF_1970 = 25_569


def as_date(c: Column) -> Column:
    t = trim(c)
    return F.when(t.rlike(ISO_DATE), F.try_to_timestamp(t))


def as_serial(c: Column) -> Column:
    """An ISO date text as a spreadsheet's date number, as written; days and months beyond the calendar run on. Null for other texts."""
    t = trim(c)
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(t, ISO_DATE, k), F.lit("")).try_cast("int"), F.lit(0))
    month = F.add_months(F.make_date(part(1), F.lit(1), F.lit(1)), part(2) - 1)
    seconds = (F.unix_date(month).cast("long") + part(3) - 1 + SERIAL_OF_1970) * 86_400 + part(4) * 3_600 + part(5) * 60 + part(6)
    return F.when(t.rlike(ISO_DATE), seconds / F.lit(86_400.0))


def as_number(c: Column) -> Column:
    t = trim(c)
    return F.when(t.rlike(r"^-?(?:0|[1-9]\d{0,14})(?:\.\d+)?$"), t.try_cast("double"))


def problem_sheet(t: DataFrame, key: str = "cluster_id") -> DataFrame:
    """One row a problem, flat: lists as ``name (count); ...`` and the three first causes as numbered lines."""
    named = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["name"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), "; ")
    cause = F.array_join(F.transform(F.slice("root_causes", 1, 3), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["cause"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), "\n")
    return problems(t, key).select(
        key, "title", "category", "n", "share", "weeks_active", "first_seen", "last_seen", "is_chronic", F.coalesce(fit(cause), F.lit("")).alias("root_causes"), "documented", "rca_coverage",
        F.round("median_hours", 6).alias("median_hours"), duration_text(F.col("median_hours")).alias("median_text"), "sla_breach_pct", "avg_score", fit(named(F.col("top_groups"))).alias("top_groups"),
        fit(named(F.col("top_agents"))).alias("top_agents"), F.array_join("sample_numbers", ", ").alias("sample_numbers"),
    )


#: Canonical columns in the order of the detail sheet.
CANONICAL = ("number", "task_type", "priority", "state", "short_description", "description", "work_notes", "assignment_group", "assigned_to", "opened", "closed", "channel", "made_sla")


def cells(c: Column, name: str, kind: str) -> list[Column]:
    """A column of one kind as typed cells: dates as serials, numbers as numbers; what is neither stays text in a column of its own."""
    if kind not in ("date", "number"):
        return [fit(F.nullif(c, F.lit(""))).alias(name)]
    value = as_serial(c) if kind == "date" else as_number(c)
    return [value.alias(name), F.when(value.isNull(), fit(F.nullif(c, F.lit("")))).alias(f"{name}_text")]


def detail_sheet(t: DataFrame, sheet: DataFrame, key: str = "cluster_id", kinds: dict[str, str] | None = None) -> DataFrame:
    """A row for each ticket of the exported problems: problem, canonical columns, what was worked out, then the file's other columns.

    ``kinds`` are those of ``column_kinds``; columns of persons are left out, and a name that the sheet has itself, in any case, gets " (origen)".
    ``root_cause`` is the score's dimension, ``root_cause_text`` the cause as written. Tickets meet their problem by ``key``, never by number, so
    repeated numbers stay one row each.
    """
    made = {*CANONICAL, *config.DIMENSION_COLUMNS, "row_id", "score", "category", "root_cause_text", "resolution_hours", "week", "month", "is_closed", "tokens", "all_notes", "human_notes", "short_desc_clean", "desc_clean", "is_auto_desc", key}
    extra = [c for c in t.columns if c not in made and c not in config.EXPORT_EXCLUDED]
    kinds, types = kinds or {}, dict(t.dtypes)
    out: list[Column] = [F.col(key), F.col("_title").alias("problem")]
    for c in CANONICAL:
        out += cells(F.col(c), c, "date") if c in ("opened", "closed") else [fit(F.nullif(F.col(c), F.lit(""))).alias(c) if types[c] == "string" else F.col(c)]
    own = [F.col("category").alias("category"), "week", F.round("resolution_hours", 6).alias("resolution_hours"), "is_closed", F.col("score.total").alias("score"), F.col("score.label").alias("label"), *[F.col(f"score.dims.{d}").alias(d) for d in config.DIMS], "root_cause_text"]
    out += own if key != "category" else own[1:]
    taken = {c.lower() for c in (*CANONICAL, *config.DIMS, "opened_text", "closed_text", "problem", "category", "week", "resolution_hours", "is_closed", "score", "label", "root_cause_text", key)}
    for c in extra:
        typed = types[c] == "string" and kinds.get(c) in ("date", "number")
        name, column = c, F.col(f"`{c}`")
        while taken & (names := {name.lower(), *([f"{name}_text".lower()] if typed else [])}):
            name += " (origen)"
        taken |= names
        out += cells(column, name, kinds.get(c, "text")) if types[c] == "string" else [column.alias(name)]
    return t.join(sheet.select(key, F.col("title").alias("_title")), key).select(*out)


def metadata_sheet(t: DataFrame, sheet: DataFrame, filters: str = "", version: str = "1") -> DataFrame:
    """(field, value): what the export holds."""
    long = [c for c, k in t.dtypes if k == "string"]
    cut = F.coalesce(F.sum(sum((F.coalesce((F.length(c) > config.CELL_LIMIT).cast("int"), F.lit(0)) for c in long), F.lit(0))), F.lit(0))
    opened = F.nullif(F.col("opened"), F.lit(""))
    row = t.agg(F.count("*").alias("n"), F.coalesce(F.min(opened), F.lit("")).alias("a"), F.coalesce(F.max(opened), F.lit("")).alias("b"), cut.alias("c")).crossJoin(sheet.agg(F.count("*").alias("p")))
    pairs = [("filters", F.lit(filters)), ("opened_from", F.col("a")), ("opened_to", F.col("b")), ("tickets", F.col("n").cast("string")), ("problems", F.col("p").cast("string")), ("scorer_version", F.lit(version)), ("truncated_cells", F.col("c").cast("string"))]
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in pairs])).alias("r")).select("r.*")


def write(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes a sheet as a folder of files; Spark's committer makes a broken job leave no half result."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).option("escape", '"').csv(path) if kind == "csv" else writer.format(kind).save(path)


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), lambda name: jvm.org.apache.hadoop.fs.Path(place, name)


def write_set(sheets: dict[str, DataFrame], path: str) -> str:
    """Writes several sheets as Parquet that appear together or not at all; returns the set's name.

    Every sheet goes to a new folder of its own first. One small marker, renamed into place when all are complete, then makes
    the set the newest: readers see the set before or the new one, whatever breaks in between. Sets are numbered by their markers.
    """
    spark = next(iter(sheets.values())).sparkSession
    system, at = _folder(spark, path)
    name = f"set-{uuid.uuid4().hex}"
    for sheet, df in sheets.items():
        write(df, f"{path}/{name}/{sheet}")
    marker = at(f"{name}/marker")
    stream = system.create(marker, True)
    stream.write(bytearray(",".join(sheets).encode()))
    stream.close()
    if not system.rename(marker, at(f"marker-{len(_markers(spark, path)):08d}-{name}")):
        raise OSError(f"the set {name} could not be made the newest in {path}")
    return name


def _markers(spark: SparkSession, path: str) -> list[str]:
    system, at = _folder(spark, path)
    found = system.globStatus(at("marker-*"))
    return sorted(f.getPath().getName() for f in found) if found else []


def read_set(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sheets of the newest complete set; none where there is none."""
    markers = _markers(spark, path)
    if not markers:
        return {}
    name = markers[-1].split("-", 2)[2]
    sheets = spark.read.text(f"{path}/{markers[-1]}").first()[0].split(",")
    return {s: spark.read.parquet(f"{path}/{name}/{s}") for s in sheets}
