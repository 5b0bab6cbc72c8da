"""Date and time functions.  The run date is a parameter so that reruns give equal results."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stagecraft.functions.strings import _col


def _int(x) -> Column:
    return F.lit(x) if isinstance(x, int) else _col(x)


def year(d) -> Column:
    return F.year(_col(d))


def month(d) -> Column:
    return F.month(_col(d))


def day(d) -> Column:
    return F.dayofmonth(_col(d))


def hour(t) -> Column:
    return F.hour(_col(t))


def minute(t) -> Column:
    return F.minute(_col(t))


def second(t) -> Column:
    return F.second(_col(t))


def day_of_week(d) -> Column:
    """1 = Sunday."""
    return F.dayofweek(_col(d))


def week_of_year(d) -> Column:
    """ISO week."""
    return F.weekofyear(_col(d))


def quarter(d) -> Column:
    return F.quarter(_col(d))


def current_date(run_date: str | None = None) -> Column:
    return F.lit(run_date).cast("date") if run_date else F.current_date()


def current_timestamp(run_time: str | None = None) -> Column:
    return F.lit(run_time).cast("timestamp") if run_time else F.current_timestamp()


def current_time(run_time: str | None = None) -> Column:
    """The stage language returns the full timestamp here."""
    return current_timestamp(run_time)


def date_from_components(y, m, d) -> Column:
    return F.make_date(_int(y), _int(m), _int(d))


def timestamp_from_components(y, mo, d, h, mi, s) -> Column:
    return F.make_timestamp(_int(y), _int(mo), _int(d), _int(h), _int(mi), _int(s))


def days_after(n, d) -> Column:
    return F.date_add(_col(d), _int(n))


def days_before(n, d) -> Column:
    return F.date_sub(_col(d), _int(n))


def date_diff(a, b) -> Column:
    """Days from b to a."""
    return F.datediff(_col(a), _col(b))


def month_diff(a, b) -> Column:
    """Months from b to a, fractional in 31sts of a month."""
    return F.months_between(_col(a), _col(b))


def date_to_string(d, fmt: str) -> Column:
    return F.date_format(_col(d), fmt)


def string_to_date(s, fmt: str) -> Column:
    """NULL where the text does not fit the format (never raises)."""
    return F.try_to_date(_col(s), fmt)
