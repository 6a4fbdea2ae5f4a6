"""Clock, day, week and month expressions.

`as_of` and other points in time may be a column, a date or datetime, or ISO text. They
enter the plan as literals, so filters built from them fold to constants.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(value) -> Column:
    if isinstance(value, Column):
        return value.cast("timestamp")
    text = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else str(value)
    return F.lit(text).cast("timestamp")


def day(value) -> Column:
    if isinstance(value, Column):
        return F.to_date(value)
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        return F.lit(value.isoformat()).cast("date")
    return F.to_date(moment(value))


def days_between(start: Column, end: Column) -> Column:
    """Midnights between two points in time."""
    return F.datediff(end, start).cast("bigint")


def week_start(value) -> Column:
    """The Sunday that opens the week."""
    d = day(value)
    return F.date_sub(d, F.dayofweek(d) - 1)


def week_of_year(value) -> Column:
    """Weeks start on Sunday; week 1 holds 1 January."""
    d = day(value)
    first_weekday = F.dayofweek(F.trunc(d, "year"))
    return (F.floor((F.dayofyear(d) + first_weekday - 2) / 7) + 1).cast("int")


def sunday_number(sunday: Column) -> Column:
    """Which Sunday of its year a Sunday is."""
    return F.floor((F.dayofyear(sunday) + 6) / 7).cast("int")


def week_label(start: Column, end: Column, months: Sequence[str] | None = None) -> Column:
    """`05-11/Mar` inside one month, `26/Feb-04/Mar` across two.

    `months` replaces the English month abbreviations by twelve others.
    """

    def month_name(d):
        if months is None:
            return F.date_format(d, "MMM")
        return F.element_at(F.array(*[F.lit(m) for m in months]), F.month(d))

    def day_month(d):
        return F.concat_ws("/", F.date_format(d, "dd"), month_name(d))

    opening = F.when(F.month(start) == F.month(end), F.date_format(start, "dd")).otherwise(
        day_month(start)
    )
    return F.regexp_replace(F.concat_ws("-", opening, day_month(end)), r"\s", "")


def month_start(value) -> Column:
    return F.trunc(day(value), "month")


def previous_month_end(value) -> Column:
    return F.date_sub(month_start(value), 1)


def short_date(d: Column) -> Column:
    """Day, month and year without padding, as shown in tables."""
    return F.concat_ws("/", F.dayofmonth(d), F.month(d), F.year(d))


def period_label(d: Column) -> Column:
    return F.concat_ws("/", F.month(d), F.year(d))
