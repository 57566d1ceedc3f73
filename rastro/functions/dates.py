"""Dates written as text: ISO or day/month/year, parsed once to DATE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rastro.functions.basic import col, strip

NO_DATE = "Sin fecha"


def parse_date(c) -> Column:
    """``yyyy-MM-dd`` (optionally followed by a time) or ``d/M/yyyy``; anything else is NULL."""
    s = F.substring(F.substring_index(strip(c), "T", 1), 1, 10)
    return (
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s.try_cast("date"))
        .when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(s, "d/M/yyyy"))
    )


def to_iso(c) -> Column:
    return parse_date(c).cast("string")  # years have four digits here


def display_date(c) -> Column:
    return F.coalesce(F.date_format(parse_date(c), "dd/MM/yyyy"), F.lit(NO_DATE))


def is_past(c, cut: Column) -> Column:
    return F.coalesce(parse_date(c) < cut, F.lit(False))


def days_overdue(dt: Column, cut: Column) -> Column:
    """Whole days a DATE lies before the cut; zero when it does not, or when there is none."""
    return F.coalesce(F.greatest(F.datediff(cut, dt), F.lit(0)), F.lit(0))
