"""Clock and calendar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_hour(ts: Column) -> Column:
    """Down to the half hour, up from 15 minutes past it; seconds are dropped."""
    minutes = F.floor(F.unix_seconds(ts) / 60)
    up = F.when(F.pmod(minutes, F.lit(30)) >= 15, 30).otherwise(0)
    return F.timestamp_seconds((minutes - F.pmod(minutes, F.lit(30)) + up) * 60)


def day_type(ts: Column) -> Column:
    return F.when(F.weekday(ts) < 5, F.lit("weekday")).otherwise(F.lit("weekend"))


def day_fraction(clock: Column) -> Column:
    """"HH:MM[:SS]" as a share of a day."""
    p = F.split(clock, ":")
    seconds = F.coalesce(F.try_element_at(p, F.lit(3)).try_cast("double"), F.lit(0.0))
    return (F.element_at(p, 1).try_cast("double") * 3600 + F.try_element_at(p, F.lit(2)).try_cast("double") * 60 + seconds) / 86400


def parse_span(span: Column) -> tuple[Column, Column]:
    """"(a, b)" as two shares of a day."""
    inner = F.split(F.regexp_replace(span, r"[()\s]", ""), ",")
    return day_fraction(F.try_element_at(inner, F.lit(1))), day_fraction(F.try_element_at(inner, F.lit(2)))


def add_minutes(clock: Column, minutes: Column) -> tuple[Column, Column]:
    """Clock time "HH:MM" after some minutes, and whether midnight was passed."""
    p = F.split(clock, ":")
    total = F.element_at(p, 1).cast("long") * 60 + F.element_at(p, 2).cast("long") + minutes
    of_day = F.pmod(total, F.lit(1440))
    return F.format_string("%02d:%02d", F.floor(of_day / 60), F.pmod(of_day, F.lit(60))), total >= 1440


def travel_minutes(metres: Column, per_minute: int = 70) -> Column:
    return (metres / per_minute).cast("long")
