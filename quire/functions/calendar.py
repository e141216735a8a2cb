"""Calendar arithmetic as Column expressions.

Three week systems appear in the case studies and are kept apart:

* ISO 8601 week (Monday start, week 1 holds the first Thursday) — ``iso_week``
* SQL-Server ``DATEPART(week, d)`` at the default first day (Sunday start,
  week 1 is the week holding 1 January) — ``sunday_week``
* SQL-Server ``DATEDIFF(WEEK, a, b)``: the number of Saturday->Sunday
  boundaries crossed from a to b — ``sunday_weeks_between``
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def iso_weekday(d) -> Column:
    """Monday = 1 .. Sunday = 7."""
    return (F.weekday(_c(d)) + 1).cast("int")


def sunday_weekday(d) -> Column:
    """Sunday = 1 .. Saturday = 7."""
    return F.dayofweek(_c(d))


def iso_week(d) -> Column:
    return F.weekofyear(_c(d))


def sunday_week(d) -> Column:
    """Week of year with Sunday-start weeks and week 1 holding 1 January."""
    d = _c(d)
    shifted = F.dayofyear(d) + F.dayofweek(F.trunc(d, "year")) - 2
    return (F.floor(shifted / 7) + 1).cast("int")


def sunday_week_start(d) -> Column:
    """The Sunday on or before ``d``."""
    return F.date_sub(F.date_trunc("week", F.date_add(_c(d), 1)).cast("date"), 1)


def sunday_weeks_between(a, b) -> Column:
    """Number of week boundaries (Saturday->Sunday) crossed going from a to b."""
    return (F.datediff(sunday_week_start(b), sunday_week_start(a)) / 7).cast("int")


def minutes_between(start, end) -> Column:
    """Elapsed minutes between two timestamps as a double (seconds / 60)."""
    return F.timestamp_diff("SECOND", _c(start), _c(end)) / 60.0


def parse_short_date(text, fmt: str = "d/M/yy", pivot: int = 2049) -> Column:
    """Parse day/month/two-digit-year text; years above ``pivot`` move back a century.

    Spark maps ``yy`` to 2000-2099; the case-study database maps 50-99 to
    the 1900s, so the default pivot 2049 reproduces it.
    """
    d = F.to_date(_c(text), fmt)
    return F.when(F.year(d) > pivot, F.add_months(d, -1200)).otherwise(d)


def format_short_date(d, fmt: str = "d/M/yy") -> Column:
    return F.date_format(_c(d), fmt)
