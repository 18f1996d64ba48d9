"""Dates as text, ISO weeks, months and durations. All times are read as UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketlens.functions.regex import SPACE, round_half_up, trim

DAY_MONTH = rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}})(?:[ T,]+(\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?[{SPACE}]*([AaPp][Mm])?)?$"
STAMP = r"^(\d{4})[-/](\d{2})[-/](\d{2})(?:[ T](\d{2}):(\d{2})(?::(\d{2}))?)?"


def _part(text: Column, pattern: str, i: int) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("int"), F.lit(0))


def day_month_date(text: Column, month_first: Column) -> Column:
    """"YYYY-MM-DD HH:MM:SS" of a day/month (or month/day) date; null where it is none or impossible."""
    t = trim(text)
    a, b, year = (_part(t, DAY_MONTH, i) for i in (1, 2, 3))
    first = (a > 12) | ((b <= 12) & ~month_first)
    hour, half = _part(t, DAY_MONTH, 4), F.lower(F.regexp_extract(t, DAY_MONTH, 7))
    hour24 = F.when(half == "", hour).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
    stamp = F.try_make_timestamp(year, F.when(first, b).otherwise(a), F.when(first, a).otherwise(b), hour24, _part(t, DAY_MONTH, 5), _part(t, DAY_MONTH, 6).cast("decimal(8,6)"))
    return F.when(t.rlike(DAY_MONTH), F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"))


def serial_date(serial: Column) -> Column:
    """Text of a spreadsheet's day number, to the nearest second."""
    return F.date_format(F.timestamp_seconds(round_half_up(serial * 86400.0) - F.lit(2209161600)), "yyyy-MM-dd HH:mm:ss")


def normalize_date(text: Column, month_first: Column, kind: str = "string") -> Column:
    if kind in ("double", "float", "int", "bigint", "decimal"):
        return F.coalesce(F.when(text != 0, serial_date(text.cast("double"))), F.lit(""))
    if kind in ("timestamp", "date", "timestamp_ntz"):
        return F.coalesce(F.date_format(text, "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    return F.coalesce(day_month_date(text, month_first), text, F.lit(""))


def timestamp(text: Column) -> Column:
    """The time at the start of a text; days and hours beyond their range roll over."""
    y, mo, d, h, mi, s = (_part(text, STAMP, i) for i in range(1, 7))
    day = F.date_add(F.add_months(F.make_date(y, F.lit(1), F.lit(1)), mo - 1), d - 1)
    return F.when(text.rlike(STAMP), day.cast("timestamp") + F.make_dt_interval(F.lit(0), h, mi, s.cast("decimal(18,6)")))


def week_key(text: Column) -> Column:
    t = timestamp(text)
    return F.when(t.isNull(), F.lit("")).otherwise(F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), t), F.weekofyear(t)))


def month_key(text: Column) -> Column:
    """YYYY-MM of the first year and month anywhere in the text, else blank."""
    pattern = r"(\d{4})[/-](\d{2})"
    return F.when(text.rlike(pattern), F.concat_ws("-", F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2))).otherwise(F.lit(""))


def week_start(key: Column) -> Column:
    """Monday of an ISO week key; null for another text."""
    jan4 = F.make_date(F.regexp_extract(key, r"^(\d{4})-W(\d{2})$", 1).try_cast("int"), F.lit(1), F.lit(4))
    return F.when(key.rlike(r"^\d{4}-W\d{2}$"), F.date_add(F.trunc(jan4, "week"), (F.regexp_extract(key, r"^(\d{4})-W(\d{2})$", 2).try_cast("int") - 1) * 7))


def week_label(key: Column) -> Column:
    start = week_start(key)
    return F.coalesce(F.concat(F.lit("W"), F.substring(key, 7, 2), F.lit(" · "), F.dayofmonth(start), F.lit(" "), F.date_format(start, "MMM")), key)


def week_range_label(key: Column) -> Column:
    start = week_start(key)
    end = F.date_add(start, 6)
    return F.coalesce(F.concat(F.dayofmonth(start), F.lit(" "), F.date_format(start, "MMM"), F.lit(" – "), F.dayofmonth(end), F.lit(" "), F.date_format(end, "MMM yyyy")), key)


def month_label(key: Column) -> Column:
    return F.coalesce(F.date_format(F.try_to_timestamp(F.concat(key, F.lit("-01")), F.lit("yyyy-MM-dd")), "MMM yyyy"), key)


def resolution_hours(opened: Column, closed: Column) -> Column:
    """Hours between two texts; null where one is missing, or below 0 or above a year."""
    hours = (F.unix_micros(timestamp(closed)) - F.unix_micros(timestamp(opened))) / 3.6e9
    return F.when((hours >= 0) & (hours <= 24 * 365), hours)


def duration_text(hours: Column) -> Column:
    number = lambda x: F.regexp_replace(round_half_up(x, 1).cast("string"), r"\.0$", "")
    return (
        F.when(hours.isNull() | F.isnan(hours), F.lit("—"))
        .when(hours < 1, F.concat(round_half_up(hours * 60).cast("string"), F.lit("m")))
        .when(hours < 48, F.concat(number(hours), F.lit("h")))
        .otherwise(F.concat(number(hours / 24), F.lit("d")))
    )
