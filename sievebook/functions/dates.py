"""Dates. Today is always passed in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold

# Month names.
MONTHS = ["ianuarie", "februarie", "martie", "aprilie", "mai", "iunie", "iulie", "august", "septembrie", "octombrie", "noiembrie", "decembrie"]


def iso_date(day: Column, month: Column, year: Column) -> Column:
    """A date from numbers in text; two-digit years over 30 are 19xx; null if there is no such day (D-01)."""
    y = year.try_cast("int")
    y = F.when(y < 100, y + F.when(y > 30, 1900).otherwise(2000)).otherwise(y)
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(day, 2, "0"), F.lpad(month, 2, "0")), "yyyy-dd-MM")


def parse_numeric_date(text: Column) -> Column:
    """The first d.m.y or d/m/y anywhere (D-02)."""
    pattern = r"(\d{1,2})[./](\d{1,2})[./](\d{2,4})"
    return iso_date(*(F.regexp_extract(text, pattern, i) for i in (1, 2, 3)))


def parse_ro_date(text: Column) -> Column:
    """The first day, month name and year (D-03)."""
    folded, pattern = fold(text), r"(\d{1,2})\s+(" + "|".join(MONTHS) + r")\s+(\d{4})"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(folded, pattern, 2))
    return iso_date(F.regexp_extract(folded, pattern, 1), month.cast("string"), F.regexp_extract(folded, pattern, 3))


def parse_birth(text: Column) -> Column:
    """Birth date of a batch line as text: y-m-d unchecked, or d.m.y padded, else empty (D-04)."""
    x, pattern = F.trim(text), r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$"
    padded = F.concat_ws("-", F.regexp_extract(x, pattern, 3), F.lpad(F.regexp_extract(x, pattern, 2), 2, "0"), F.lpad(F.regexp_extract(x, pattern, 1), 2, "0"))
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), x).when(x.rlike(pattern), padded).otherwise(F.lit(""))


def recent(applied: Column, as_of: Column, days: int = 365) -> Column:
    """D-06, the last day included."""
    return F.coalesce(applied >= F.date_sub(as_of, days), F.lit(False))


def lag_days(source: Column, local: Column) -> Column:
    """Days from source to local listing, null unless positive (D-07)."""
    d = F.datediff(local, source)
    return F.when(d > 0, d)


def month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")
