"""Calendar arithmetic on date columns.

Month and year differences count calendar boundaries crossed (31 Jan to 1 Feb is one
month), which is not what ``months_between`` or ``timestampdiff`` return.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def date_lit(text: str | dt.date) -> Column:
    return F.lit(text if isinstance(text, dt.date) else dt.date.fromisoformat(text))


def month_start(d: str | Column) -> Column:
    return F.trunc(col(d), "MONTH")


def month_index(d: str | Column) -> Column:
    """Months since year 0, so that a month range is an integer range."""
    return F.year(col(d)) * 12 + F.month(col(d))


def month_diff(later: str | Column, earlier: str | Column) -> Column:
    return (month_index(later) - month_index(earlier)).cast("bigint")


def year_diff(later: str | Column, earlier: str | Column) -> Column:
    return (F.year(col(later)) - F.year(col(earlier))).cast("bigint")


def day_diff(later: str | Column, earlier: str | Column) -> Column:
    return F.datediff(col(later), col(earlier)).cast("bigint")


def add_months(d: str | Column, n: int) -> Column:
    """``n`` months later, clamped to the last day of the target month."""
    return F.add_months(col(d), n)


def is_month_end(d: str | Column) -> Column:
    return col(d) == F.last_day(col(d))


def datetime_text_to_date(c: str | Column) -> Column:
    """Strict: text that is no datetime raises."""
    return col(c).cast("timestamp_ntz").cast("date")


def year_text_to_date(c: str | Column, floor: int = 1900) -> Column:
    """First of January of the year written in ``c``; years below ``floor`` become ``floor``.

    A NULL year counts as year 0 and so becomes ``floor`` too.
    """
    year = F.coalesce(col(c), F.lit("0")).cast("int")
    text = F.when(year < floor, F.lit(str(floor))).otherwise(col(c))
    return F.concat(text, F.lit("-01-01")).cast("date")


def month_ends(first: str | dt.date, last: str | dt.date) -> list[dt.date]:
    """Every month-end from ``first`` to ``last``, both months included."""
    a = first if isinstance(first, dt.date) else dt.date.fromisoformat(first)
    b = last if isinstance(last, dt.date) else dt.date.fromisoformat(last)
    out = []
    for ix in range(a.year * 12 + a.month, b.year * 12 + b.month + 1):
        # ix is one past the zero-based month, i.e. the following month
        out.append(dt.date(ix // 12, ix % 12 + 1, 1) - dt.timedelta(days=1))
    return out
