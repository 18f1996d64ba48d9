"""Reading ticket exports: encodings, headers, column kinds, load checks, the canonical columns."""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from ticketlens import config
from ticketlens.functions.dates import DAY_MONTH, normalize_date
from ticketlens.functions.regex import known, trim
from ticketlens.functions.text import clean_text, is_auto_description, parse_notes
from ticketlens.plans.shared import stored

_EMAIL_HEADER = re.compile(r"(?:[^.]+\.)*e-?mail", re.I)
MAPPED = {h for names in config.SOURCE_COLUMNS.values() for h in names}
#: What windows-1252 has at bytes 0x80 to 0x9F; Latin-1 reads them as control characters. Five bytes have no character.
CP1252 = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def is_email_header(header: str) -> bool:
    """``email`` or ``e-mail`` alone or after the last dot."""
    return bool(_EMAIL_HEADER.fullmatch(header.strip()))


def drop_email_columns(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if is_email_header(c)])


def unmapped_columns(df: DataFrame) -> list[str]:
    """Columns outside the canonical ones, in the file's order; e-mail columns are never kept."""
    return [c for c in df.columns if c not in MAPPED and not is_email_header(c)]


def source_header(df: DataFrame, names: tuple[str, ...]) -> str | None:
    """The first name that is a column, even if its cells are blank."""
    there = set(df.columns)
    return next((n for n in names if n in there), None)


def _quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def _records(lines: DataFrame) -> DataFrame:
    """(file, record, text) of lines (file, block, id, value): a line break inside quotes does not end a record.

    Lines are those of Spark's splits, so a large file is read by many tasks. Blocks count their quotes, and the records that begin in them if an even or
    an odd number of quotes comes before; sums over blocks then tell which it is, so that texts move to their blocks once. Only then are the few
    lines of a record put together. Records count from 1.
    """
    place = Window.partitionBy("file", "block").orderBy("id")
    before = F.coalesce(F.sum("_q").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = lambda *more: lines.select("file", "block", "id", *more, _quotes(F.col("value")).alias("_q")).withColumn("_odd", before % 2)
    begun = F.when(F.col("_turned") == 1, F.col("_n1")).otherwise(F.col("_n") - F.col("_n1"))
    over = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = told().groupBy("file", "block").agg(F.sum("_q").alias("_q"), F.sum("_odd").alias("_n1"), F.count("*").alias("_n"))
    blocks = blocks.withColumn("_turned", F.coalesce(F.sum("_q").over(over), F.lit(0)) % 2).withColumn("_base", F.coalesce(F.sum(begun).over(over), F.lit(0)))
    up_to = place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = told("value").withColumns({"_n1": F.sum("_odd").over(up_to), "_n": F.count("*").over(up_to)}).drop("_q", "_odd")
    placed = rows.join(blocks.select("file", "block", "_turned", "_base"), ["file", "block"]).withColumn("record", F.col("_base") + begun)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "id", "value"))), lambda x: x["value"]), "\n")
    return placed.groupBy("file", "record").agg(joined.alias("text"))


def _named(df: DataFrame) -> DataFrame:
    """No null cells, no byte-order mark in names."""
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    return df.select(*[F.coalesce(_quoted(c), F.lit("")).alias(c) for c in df.columns])


def read_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """CSV files with a header each; a file that is not valid UTF-8 is read as windows-1252.

    Files are split like any text, whatever is quoted in them, so one of many gigabytes is read by many tasks. Their
    encoding is decided from all of their lines; the driver sees a row for each file (its path, encoding and header). Columns are
    joined by name, and a missing or empty cell is ''. A byte-order mark is dropped. Files in UTF-16, which cannot be split at lines, are
    read by a task each.
    """
    source = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    source = stored(source, "zstd")  # read once: another scan may cut the files into other splits
    marks = F.hex(F.substring(F.col("value").cast("binary"), 1, 2))
    first = F.min_by(marks, F.struct("block", "id"))
    kinds = {r.file: "UTF-16" if r.mark in ("FFFE", "FEFF") else "UTF-8" if r.utf8 else "ISO-8859-1" for r in source.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), first.alias("mark")).collect()}
    parts = []
    if wide := [f for f, k in kinds.items() if k == "UTF-16"]:
        parts.append(_named(spark.read.csv(wide, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-16", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)))
    table = str.maketrans({chr(b): c for b, c in CP1252.items()})
    for encoding in ("ISO-8859-1", "UTF-8"):
        if not (named := [f for f, k in kinds.items() if k == encoding]):
            continue
        lines = source.filter(F.col("file").isin(*named))
        if encoding == "ISO-8859-1":
            decoded = F.decode(F.col("value").cast("binary"), encoding)
            lines = lines.withColumn("value", F.translate(decoded, "".join(map(chr, CP1252)), "".join(CP1252.values())))
        records = stored(_records(lines), "zstd")
        headers: dict[str, list[str]] = {}
        for r in records.filter("record = 1").select("file", "text").collect():
            headers.setdefault(r.text.lstrip("\ufeff"), []).append(r.file)
        options = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
        for header, files in sorted(headers.items()):
            names = [c.translate(table) if encoding == "ISO-8859-1" else c for c in next(csv.reader(io.StringIO(header)))]
            names = [c if c.strip() else f"_c{i}" for i, c in enumerate(names)]
            schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])
            cells = records.filter(F.col("file").isin(*files) & (F.col("record") > 1) & (F.col("text") != "")).select(F.from_csv("text", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options).alias("r"))
            parts.append(_named(cells.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select(*[F.coalesce(_quoted(c), F.lit("")).alias(c) for c in out.columns])


def infer_month_first(df: DataFrame) -> bool:
    """Whether day/month dates of the file put the month first: a vote of the unambiguous ones, strictly more."""
    names = [n for c in ("opened", "closed") for n in config.SOURCE_COLUMNS[c] if n in df.columns and dict(df.dtypes)[n] == "string"]
    if not names:
        return False
    part = lambda n, i: F.regexp_extract(trim(_quoted(n)), DAY_MONTH, i).try_cast("int")
    votes = [(part(n, 1) > 12, (F.coalesce(part(n, 1), F.lit(99)) <= 12) & (part(n, 2) > 12)) for n in names]
    day, month = df.agg(*[F.sum(F.lit(0) + sum((F.coalesce(v[i].cast("int"), F.lit(0)) for v in votes), F.lit(0))) for i in (0, 1)]).first()
    return (month or 0) > (day or 0)


def sla_flag(c: Column, kind: str) -> Column:
    """True, false or unknown (null, blank)."""
    if kind == "boolean":
        return c
    if kind != "string":
        return c != 0
    t = trim(c)
    return F.when(t != "", t.rlike("(?iu)^(true|yes|y|1|si|sí)$"))


def canonical(df: DataFrame, row_id: Column, month_first: bool | None = None) -> DataFrame:
    """row_id, the canonical columns, the optional dimensions (null where blank or absent) and the file's other columns."""
    kinds, order = dict(df.dtypes), F.lit(infer_month_first(df) if month_first is None else month_first)

    def cell(name: str) -> Column:
        header = source_header(df, config.SOURCE_COLUMNS[name])
        return F.lit("") if header is None else _quoted(header)

    out = [row_id.cast("long").alias("row_id")]
    for name, headers in config.SOURCE_COLUMNS.items():
        header = source_header(df, headers)
        if name in ("opened", "closed"):
            out.append((normalize_date(cell(name), order, kinds[header].split("(")[0]) if header else F.lit("")).alias(name))
        elif name == "made_sla":
            out.append((sla_flag(_quoted(header), kinds[header]) if header else F.lit(None).cast("boolean")).alias(name))
        elif name == "priority":
            text = F.coalesce(cell(name).cast("string"), F.lit(""))
            for broken, right in (("â€“", "–"), ("â€œ", "“"), ("â€\u009d", "”")):
                text = F.regexp_replace(text, broken, right)
            out.append(trim(text).alias(name))
        else:
            text = F.coalesce(cell(name).cast("string"), F.lit(""))
            out.append((F.when(text == "", F.lit("Incident")).otherwise(text) if name == "task_type" else text).alias(name))
    for name, headers in config.DIMENSION_COLUMNS.items():
        header = source_header(df, headers)
        out.append((known(_quoted(header).cast("string")) if header else F.lit(None).cast("string")).alias(name))
    taken = {*config.SOURCE_COLUMNS, *config.DIMENSION_COLUMNS, "row_id"}
    return df.select(*out, *[_quoted(c).alias(c if c.lower() not in taken else f"{c} (source)") for c in unmapped_columns(df)])


def enriched(incidents: DataFrame) -> DataFrame:
    """Adds cleaned texts, notes and the automatic-description flag to canonical columns."""
    notes = parse_notes(F.col("work_notes"))
    out = incidents.withColumns(
        {
            "short_desc_clean": clean_text(F.col("short_description")),
            "desc_clean": clean_text(F.col("description")),
            "all_notes": F.coalesce(notes, F.expr("array()").cast("array<struct<timestamp:string,author:string,text:string,is_system:boolean>>")),
            "is_auto_desc": is_auto_description(F.col("description")),
        }
    )
    return out.withColumn("human_notes", F.filter("all_notes", lambda n: ~n["is_system"]))


#: Fixed patterns: ISO date text, plain decimal text, and headers whose digits are codes.
_ISO = r"^\d{4}-\d{2}-\d{2}(?: \d{2}:\d{2}(?::\d{2})?)?$"
_NUMBER = r"^-?(?:0|[1-9]\d{0,14})(?:\.\d+)?$"
_IDENTIFIER = re.compile(r"(?i:(^|[^a-z])(ids?|numbers?|no|nbr|num|codes?|keys?|refs?|sys_id)([^a-z]|$)|#)|[a-z](ID|Id)\b", re.A)


def column_kinds(df: DataFrame) -> dict[str, str]:
    """date, number or text for every unmapped column, from all of its filled cells, in one pass.

    Date: every filled cell is an ISO date text. Number: every filled cell is a number or plain decimal
    text, and texts of digits do not stand under an identifier's header. A column without cells is text.
    """
    names, kinds = unmapped_columns(df), dict(df.dtypes)
    if not names:
        return {}
    aggregates = []
    for i, n in enumerate(names):
        t = trim(_quoted(n).cast("string"))
        filled = t != ""
        aggregates += [F.count_if(filled).alias(f"f{i}"), F.count_if(filled & t.rlike(_ISO)).alias(f"d{i}"), F.count_if(filled & t.rlike(_NUMBER)).alias(f"n{i}")]
    row = df.agg(*aggregates).first()
    out = {}
    for i, n in enumerate(names):
        filled, dates, numbers = row[f"f{i}"], row[f"d{i}"], row[f"n{i}"]
        as_text = kinds[n] == "string"
        out[n] = "text" if not filled else "date" if filled == dates else "number" if filled == numbers and not (as_text and _IDENTIFIER.search(n)) else "text"
    return out


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Unmapped columns cast by their kind; cells that do not fit stay null only where they were blank."""
    casts = {"date": lambda c: F.try_to_timestamp(F.nullif(trim(c), F.lit(""))), "number": lambda c: trim(c.cast("string")).try_cast("double")}
    return df.withColumns({n: casts[k](_quoted(n)) for n, k in kinds.items() if k in casts})


@dataclass(frozen=True)
class LoadCheck:
    severity: str
    message: str


def load_checks(df: DataFrame, raw_quotes: int | None = None) -> DataFrame:
    """(severity, message) of a loaded table: no rows, missing columns, cells without a header, odd quotes."""
    spark, found = df.sparkSession, []
    headerless = [c for c in df.columns if re.fullmatch(r"_c\d+", c) or not c.strip()]
    rows, loose = df.agg(F.count("*"), F.count_if(F.lit(False) if not headerless else F.greatest(*[(trim(_quoted(c).cast("string")) != "").cast("int") for c in headerless], F.lit(0)) > 0)).first()
    if not df.columns:
        found.append(LoadCheck("error", "The file is empty."))
    elif not rows:
        found.append(LoadCheck("error", "The file has no rows."))
    if df.columns and source_header(df, config.SOURCE_COLUMNS["number"]) is None:
        found.append(LoadCheck("error", "Column Number is missing."))
    if df.columns and not any(source_header(df, config.SOURCE_COLUMNS[c]) for c in ("short_description", "description")):
        found.append(LoadCheck("error", "Columns Short description and Description are both missing."))
    if loose:
        found.append(LoadCheck("warning", f"{loose} rows have values in columns without a header."))
    if raw_quotes is not None and raw_quotes % 2:
        found.append(LoadCheck("warning", "The text has an odd number of quotation marks."))
    return spark.createDataFrame([(c.severity, c.message) for c in found], "severity string, message string")


def count_quotes(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).agg(F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))).first()[0] or 0
