"""Functions whose meaning differs between the dialect that users write and Spark, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridex.plans.dialect import accents



def strip_accents(x: Column) -> Column:
    return F.translate(x, *accents())


def day_of_week(x: Column) -> Column:
    """Sunday is 0."""
    return (F.dayofweek(x) - 1).cast("long")


def trunc(unit: str, x: Column) -> Column:
    """date_trunc without a time zone."""
    return F.date_trunc(unit, x).cast("timestamp_ntz")


def boundaries(unit: str, a: Column, b: Column) -> Column:
    """How many boundaries of the unit lie between a and b, not how many whole units."""
    if unit == "day":
        return F.datediff(F.to_date(b), F.to_date(a)).cast("long")
    if unit in ("year", "month"):
        months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
        return (F.year(b) - F.year(a) if unit == "year" else months).cast("long")
    size = {"hour": 3600, "minute": 60, "second": 1}[unit]
    return (F.floor(F.unix_timestamp(b.cast("timestamp")) / size) - F.floor(F.unix_timestamp(a.cast("timestamp")) / size)).cast("long")


def decimal_text(x: Column) -> Column:
    """1.234,5 as a number; empty is null."""
    return F.nullif(F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit(".")), F.lit("")).try_cast("double")


def last_value_by(x: Column, time: Column) -> Column:
    """The value at the latest time."""
    return F.max_by(x, time)
