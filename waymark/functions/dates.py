"""Dates and hours as people write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: days after which a confirmed fact is too old.
STALE_DAYS = 90


def strict_date(written: Column) -> Column:
    """A date written as yyyy-mm-dd that the calendar has; anything else is null."""
    return F.when(written.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), written.try_cast("date"))


def is_stale(confirmed: Column, today: Column) -> Column:
    """Whether a fact confirmed on a date is too old; without a date it is."""
    return F.coalesce(F.datediff(today, confirmed) > STALE_DAYS, F.lit(True))


def minute_of(written: Column) -> Column:
    """Minutes of the day of h:mm up to 24:00; anything else is null."""
    hour = F.regexp_extract(written, r"^([0-9]{1,2}):([0-9]{2})$", 1).try_cast("int")
    minute = F.regexp_extract(written, r"^([0-9]{1,2}):([0-9]{2})$", 2).try_cast("int")
    total = hour * 60 + minute
    return F.when((minute < 60) & (total <= 1440), total)
