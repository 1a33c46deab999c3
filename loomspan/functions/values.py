"""Dates, numbers, arrays and JSON as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(x: Column) -> Column:
    """``YYYY`` to its first day, else a leading Y-M-D (``/`` counts as ``-``); anything else, ``YYYY-MM`` too, is null (DAT01)."""
    v = F.regexp_replace(F.trim(x), "/", "-")
    day = F.regexp_extract(v, r"^(\d{4}-\d{1,2}-\d{1,2})", 1)
    return F.when(v.rlike(r"^\d{4}$"), F.try_to_date(F.concat(v, F.lit("-01-01")), "yyyy-MM-dd")).when(day != "", F.try_to_date(day, "yyyy-M-d"))


def time_delta(source: Column, target: Column) -> Column:
    """Days from source to target, null if either is (DAT02)."""
    return F.datediff(target, source)


def chronology_slice(given: Column, day: Column) -> Column:
    """What is given, else ``YYYY-MM``, else ``unknown`` (DAT03)."""
    return F.coalesce(F.nullif(given, F.lit("")), F.date_format(day, "yyyy-MM"), F.lit("unknown"))


def bounded_year(day: Column) -> Column:
    """The year if it is from 1500 to 2100 (DAT04)."""
    return F.when(F.year(day).between(1500, 2100), F.year(day))


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def year_span(texts: Column) -> Column:
    """``min-max`` of the years that the text names, or one year, or empty (DAT05)."""
    years = F.transform(F.regexp_extract_all(texts, F.lit(r"\b(1[5-9]\d{2}|20\d{2}|2100)\b"), F.lit(1)), lambda y: y.cast("int"))
    low, high = F.array_min(years), F.array_max(years)
    return F.when(F.size(years) == 0, F.lit("")).when(low == high, low.cast("string")).otherwise(F.concat_ws("-", low, high))


def clamp01(x: Column) -> Column:
    """Into 0 to 1; null is 0 (MTH01)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x.cast("double"), F.lit(0.0))))


def number(x: Column, other: float = 0.0) -> Column:
    """A number from text, ``other`` where it is none (MTH01)."""
    return F.coalesce(x.try_cast("double"), F.lit(other))


def mean0(x: Column) -> Column:
    """Aggregate mean, 0 over no rows (MTH01)."""
    return F.coalesce(F.avg(x), F.lit(0.0))


def weighted(parts: dict[float, Column]) -> Column:
    """Sum of weight times part (MTH02)."""
    out = F.lit(0.0)
    for weight, part in parts.items():
        out = out + F.lit(weight) * part
    return out


def first_non_empty(*values: Column) -> Column:
    """The first that is neither null nor blank (JSN01)."""
    return F.coalesce(*(F.when(F.trim(v) != "", v) for v in values))


def run_signature(*values: Column) -> Column:
    """SHA-256 over the values as JSON in the given order (JSN03)."""
    return F.sha2(F.to_json(F.struct(*values)), 256)
