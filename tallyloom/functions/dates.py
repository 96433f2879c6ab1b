"""Dates in many spellings, periods and display times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.operators.quality import strip

#: Accepted spellings, in the order in which they are tried.
DATE_FORMATS = ["yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "MMMM d, yyyy", "MMM d, yyyy"]
VOUCHER_FORMATS = ["M/d/yyyy", "yyyy-M-d"]


def _parse(text: Column, formats: list[str]) -> Column:
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def moment(value: Column) -> Column:
    """The time that an ISO text names, a day's being its beginning; null for none, for empty texts and for what names no day."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), value.try_cast("timestamp"))


def friendly_date(value: Column) -> Column:
    """``12 Dec 2025``, the text itself if no spelling fits, a dash if there is none."""
    text = strip(value)
    parsed = F.coalesce(_parse(text, DATE_FORMATS), text.try_cast("timestamp"))
    return F.when(F.coalesce(value, F.lit("")) == "", "—").otherwise(F.coalesce(F.date_format(parsed, "dd MMM yyyy"), text))


def voucher_date(value: Column) -> Column:
    return F.date_format(_parse(strip(value), VOUCHER_FORMATS), "yyyy-MM-dd")


def statement_period(end_date: Column, run_time: Column) -> Column:
    """Month of the statement's end, else of the run."""
    return F.coalesce(F.left(end_date, F.lit(7)), F.date_format(run_time, "yyyy-MM"))


def period_label(period: Column) -> Column:
    parsed = F.try_to_timestamp(period, F.lit("yyyy-MM"))
    return F.when(F.coalesce(period, F.lit("")) == "", "—").otherwise(F.coalesce(F.date_format(parsed, "MMM yyyy"), period))


def friendly_time(ts: Column, now: Column, zone: str = "+05:30") -> Column:
    """12-hour local time, with ``Today`` for the day of ``now``."""
    local, today = F.from_utc_timestamp(ts, zone), F.from_utc_timestamp(now, zone)
    clock = F.date_format(local, "h:mm a")
    day = F.when(F.to_date(local) == F.to_date(today), "Today").otherwise(F.date_format(local, "MMM dd, yyyy"))
    return F.when(ts.isNull(), "—").otherwise(F.concat_ws(", ", day, clock))
