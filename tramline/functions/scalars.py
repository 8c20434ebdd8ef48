"""Scalar expressions: times, numbers, calendar parts, text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_s(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp, with or without zone (UTC)."""
    return F.unix_seconds(ts.cast("timestamp"))


def iso_time(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")


def number(c: Column) -> Column:
    """A number from text; what can't be read, NaN and infinities become null."""
    return finite(c.try_cast("double"))


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def clamp(c: Column, low: float, high: float) -> Column:
    """c within [low, high]; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or null."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def calendar(seconds: Column, prefix: str = "") -> dict[str, Column]:
    """hour, minute and dow (Monday = 0) of an epoch time."""
    ts = F.timestamp_seconds(seconds)
    return {f"{prefix}hour": F.hour(ts), f"{prefix}minute": F.minute(ts), f"{prefix}dow": F.weekday(ts)}


def whole_days_off(ts: Column, ref: Column) -> Column:
    """Days by which ts lies from ref, halves to even."""
    return F.bround((ts - ref) / 86400).cast("long")


def align_day(ts: Column, ref: Column) -> Column:
    """ts moved by whole days to the day around ref; the second of the day stays."""
    return ts - 86400 * whole_days_off(ts, ref)


def falsy(text: Column) -> Column:
    """Whether an environment setting says no."""
    return F.lower(F.trim(text)).isin("", "0", "false", "no", "off")


def risk(minutes: Column) -> Column:
    """Bucket of a delay in minutes."""
    return F.when(minutes >= 5, "critical").when(minutes >= 2, "high").when(minutes >= 0.5, "moderate").otherwise("normal")
