"""Wall-clock arithmetic on TIMESTAMP_NTZ columns.

`date_trunc`, `date_format` and `unix_timestamp` go through the session time
zone, which moves readings taken around a clock change. Everything here stays on the wall clock.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3600
DAY = 86400

SEASONS = {1: "Winter", 2: "Spring", 3: "Summer", 4: "Fall"}


def epoch_seconds(ts: Column) -> Column:
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return days * DAY + F.hour(ts) * HOUR + F.minute(ts) * 60 + F.second(ts)


def from_epoch(seconds: Column) -> Column:
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    zero = F.lit(0)
    return origin + F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))


def shift(ts: Column, seconds: int) -> Column:
    zero = F.lit(0)
    return ts + F.make_dt_interval(zero, zero, zero, F.lit(seconds).cast("decimal(18,6)"))


def floor_epoch(ts: Column, step: int) -> Column:
    """Start of the `step`-second slot a reading falls in, as epoch seconds."""
    return F.floor(epoch_seconds(ts) / F.lit(step)).cast("long") * F.lit(step)


def floor_to(ts: Column, step: int) -> Column:
    return from_epoch(floor_epoch(ts, step))


def two_digits(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def clock_time(ts: Column) -> Column:
    return F.concat_ws(":", two_digits(F.hour(ts)), two_digits(F.minute(ts)), two_digits(F.second(ts)))


def season(ts: Column) -> Column:
    number = F.floor((F.month(ts) % 12 + 3) / 3).cast("int")
    names = F.create_map(*[F.lit(x) for pair in SEASONS.items() for x in pair])
    return F.element_at(names, number)


def calendar_parts(ts: Column) -> dict[str, Column]:
    """Categorical calendar columns; DoW counts from Monday = 0."""
    return {
        "Year": F.year(ts),
        "Day": F.dayofmonth(ts),
        "DoW": F.weekday(ts),
        "DoY": F.dayofyear(ts),
        "Month": F.month(ts),
        "Hour": F.hour(ts),
        "Minute": F.minute(ts),
    }


def cyclical_parts(ts: Column) -> dict[str, Column]:
    """The calendar on the unit circle, plus the plain year."""
    turns = {
        "hour": (F.hour(ts) * HOUR + F.minute(ts) * 60) / F.lit(float(DAY)),
        "day_in_month": F.dayofmonth(ts) / F.dayofmonth(F.last_day(F.to_date(ts))),
        "day_in_week": F.weekday(ts) / F.lit(7.0),
        "day_in_year": F.dayofyear(ts) / F.lit(365.0),
        "month": F.month(ts) / F.lit(12.0),
    }
    parts = {"Year": F.year(ts)}
    for name, turn in turns.items():
        parts[f"sin_{name}"] = F.sin(turn * (2 * math.pi))
        parts[f"cos_{name}"] = F.cos(turn * (2 * math.pi))
    return parts


def iso_week(ts: Column) -> Column:
    return F.weekofyear(ts)


def period_group(ts: Column, period: str) -> Column:
    """Grouping key for grouped error measures and box statistics."""
    groups = {
        "hour": lambda: F.hour(ts),
        "DoW": lambda: F.weekday(ts),
        "day": lambda: F.dayofmonth(ts),
        "DoY": lambda: F.dayofyear(ts),
        "week": lambda: iso_week(ts),
        "month": lambda: F.month(ts),
        "season": lambda: season(ts),
        "year": lambda: F.year(ts),
    }
    if period not in groups:
        raise ValueError(f"unknown period {period!r}; use one of {sorted(groups)}")
    return groups[period]()


def horizon_block(ts: Column, horizon: str, iso_year: bool = False) -> Column:
    """Forecast block of a row: its hour, its day, or its week.

    Weeks pair the calendar year with the ISO week number, so the days around
    New Year form odd-sized blocks; `iso_year=True` keeps such weeks whole.
    """
    day = F.to_date(ts).cast("string")
    if horizon == "hour":
        return F.concat_ws(" ", day, two_digits(F.hour(ts)))
    if horizon == "day":
        return day
    if horizon == "week":
        year = F.extract(F.lit("YEAROFWEEK"), ts) if iso_year else F.year(ts)
        return F.format_string("%d-W%02d", year, iso_week(ts))
    raise ValueError(f"unknown horizon {horizon!r}; use hour, day or week")
