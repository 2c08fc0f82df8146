"""Calendar periods of the four regular frequencies, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frequency_code(text: Column) -> Column:
    """D, W, M or Q of a frequency however it is spelled; null if null or unknown."""
    t = F.lower(F.trim(text))
    return (
        F.when(t.rlike(r"^(business|work(ing)?|trading)?[ _-]*d(ay|ai|$)|^b(d|day|days)?$"), "D")
        .when(t.rlike(r"^w(eek|k|$)"), "W")
        .when(t.rlike(r"^m(onth|th|o|$)"), "M")
        .when(t.rlike(r"^q(uarter|tr|$)"), "Q")
    )


def period_day(sec: Column, code: Column) -> Column:
    """First day (date) of the UTC period of frequency `code` that holds the epoch second.

    Days are Monday to Friday, a weekend reading belongs to its Friday; weeks begin on Monday.
    """
    day = F.date_from_unix_date(F.floor(sec / F.lit(86400)).cast("int"))
    weekday = F.weekday(day)
    return (
        F.when(code == "D", F.date_sub(day, F.greatest(weekday - 4, F.lit(0))))
        .when(code == "W", F.trunc(day, "week"))
        .when(code == "M", F.trunc(day, "month"))
        .when(code == "Q", F.trunc(day, "quarter"))
    )
