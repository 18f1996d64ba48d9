"""Filters of a ticket population, compiled to one predicate that Spark pushes down."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Selection:
    """Chosen values of a dimension, and whether tickets without a value are chosen. Nothing chosen: no filter."""

    values: tuple[str, ...] = ()
    missing: bool = False

    @property
    def active(self) -> bool:
        return bool(self.values) or self.missing

    def toggle(self, value: str) -> Selection:
        kept = tuple(v for v in self.values if v != value)
        return replace(self, values=kept if value in self.values else (*self.values, value))

    def toggle_missing(self) -> Selection:
        return replace(self, missing=not self.missing)

    def predicate(self, column: str) -> Column:
        chosen = F.col(column).isin(*self.values) if self.values else F.lit(False)
        return F.coalesce(chosen, F.lit(False)) | (F.col(column).isNull() & F.lit(self.missing))


@dataclass(frozen=True)
class Filters:
    """Months, services and offerings, all of which must hold; inactive parts do not count."""

    months: tuple[str, ...] = ()
    service: Selection = field(default_factory=Selection)
    service_offering: Selection = field(default_factory=Selection)

    @property
    def active(self) -> bool:
        return bool(self.months) or self.service.active or self.service_offering.active

    def without(self, dimension: str) -> Filters:
        return replace(self, **{dimension: Selection()})

    def predicate(self) -> Column:
        keep = F.lit(True)
        if self.months:
            keep &= F.col("month").isin(*self.months)
        for name in ("service", "service_offering"):
            if (chosen := getattr(self, name)).active:
                keep &= chosen.predicate(name)
        return keep


def by_months(t: DataFrame, months: list[str]) -> DataFrame:
    """Tickets of the months; none for an empty list."""
    return t.filter(F.col("month").isin(*months) if months else F.lit(False))


def filtered(t: DataFrame, filters: Filters) -> DataFrame:
    return t.filter(filters.predicate())


def searched(t: DataFrame, text: str = "", label: str | None = None, group: str | None = None, state: str | None = None) -> DataFrame:
    """Tickets with the text in number, agent, short description or group, and equal label, group and state."""
    keep = F.lit(True)
    if text.strip():
        s = text.strip().lower()
        keep &= F.greatest(*[F.lower(c).contains(s).cast("int") for c in ("number", "assigned_to", "short_description", "assignment_group")]) == 1
    for column, value in (("score.label", label), ("assignment_group", group), ("state", state)):
        if value:
            keep &= F.col(column) == value
    return t.filter(keep)


def with_label(t: DataFrame, label: str | None) -> DataFrame:
    return t if label is None else t.filter(F.col("score.label") == label)


def options(t: DataFrame, column: str) -> DataFrame:
    """(value) distinct and not blank."""
    return t.select(F.col(column).alias("value")).filter("value IS NOT NULL AND value <> ''").distinct()


def dimension_options(t: DataFrame, column: str) -> DataFrame:
    """(value, has_missing): known values of the whole file, and on each row whether any ticket has none."""
    missing = t.agg(F.coalesce(F.bool_or(F.col(column).isNull()), F.lit(False)).alias("has_missing"))
    return options(t, column).crossJoin(missing)
