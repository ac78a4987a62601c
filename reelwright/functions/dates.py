"""Date and duration expressions. The reference day is always a parameter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelwright.constants import TICKS_PER_MINUTE, TICKS_PER_SECOND
from reelwright.functions.util import first_non_blank


def day(as_of: dt.date | str) -> Column:
    return F.lit(str(as_of)).cast("date")


def iso_date(text: Column) -> Column:
    """Date in the first ten characters, null when they are not one."""
    return F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def days_since(text: Column, as_of: dt.date | str) -> Column:
    return F.datediff(day(as_of), iso_date(text))


def age_years(text: Column, as_of: dt.date | str) -> Column:
    """Years since a date; 0 when it is missing or unreadable."""
    return F.coalesce(days_since(text, as_of) / F.lit(365.25), F.lit(0.0))


def ticks_to_minutes(ticks: Column) -> Column:
    return F.when(ticks > 0, ticks / F.lit(float(TICKS_PER_MINUTE)))


def ticks_to_seconds(ticks: Column) -> Column:
    return F.when(ticks > 0, ticks / F.lit(float(TICKS_PER_SECOND)))


def iso_timestamp(text: Column) -> Column:
    """Timestamp of an ISO string that has a time part, else null."""
    return F.when(text.contains("T"), F.try_to_timestamp(text))


def date_rating_exact(text: Column) -> Column:
    """Epoch seconds of the moment, 0 when unreadable."""
    return F.coalesce(F.unix_timestamp(iso_timestamp(text)), F.lit(0).cast("bigint"))


def date_rating_day(text: Column, as_of_epoch: int) -> Column:
    """Epoch seconds of the day, not later than the reference moment, 0 when unreadable."""
    moment = F.unix_timestamp(F.when(text.contains("T"), iso_date(text)).cast("timestamp"))
    capped = F.when(moment.isNotNull(), F.least(moment, F.lit(as_of_epoch).cast("bigint")))
    return F.coalesce(capped, F.lit(0).cast("bigint"))


def _shown(text: Column, pattern: str) -> Column:
    """An ISO moment in display form; other text passes through; blank gives null."""
    return first_non_blank(F.coalesce(F.date_format(iso_timestamp(text), pattern), text))


def resolve_date_added(
    date_created: Column,
    date_modified: Column,
    premiere_date: Column,
    end_date: Column,
    production_year: Column,
) -> Column:
    """Display date by falling back over the date fields, "unknown" when all are blank."""
    year = F.when(
        F.coalesce(production_year, F.lit(0)) != 0,
        F.concat(production_year.cast("string"), F.lit("-01-01 (year only)")),
    )
    return F.coalesce(
        _shown(date_created, "yyyy-MM-dd HH:mm"),
        _shown(date_modified, "yyyy-MM-dd HH:mm"),
        _shown(premiere_date, "yyyy-MM-dd"),
        _shown(end_date, "yyyy-MM-dd"),
        year,
        F.lit("unknown"),
    )


def premiere_day(premiere_date: Column) -> Column:
    return F.coalesce(_shown(premiere_date, "yyyy-MM-dd"), F.lit("unknown"))
