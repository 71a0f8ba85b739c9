"""Column expressions that the jobs share: missing numbers, guarded ratios, months and origin periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CADENCE_MONTHS = {"annual": 12, "quarterly": 3}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """The number, or null where it is null, NaN or infinite."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den``, null unless both are finite and ``den`` is positive."""
    num, den = finite(num), finite(den)
    return F.when(den > 0, num / den)


def month_index(date: Column | str) -> Column:
    return F.year(col(date)) * 12 + F.month(col(date)) - 1


def last_complete_month(as_of: str) -> Column:
    """The index of the last month that is over on the as-of date."""
    date = F.lit(as_of).cast("date")
    return F.when(date == F.last_day(date), month_index(date)).otherwise(month_index(date) - 1)


def period_index(date: Column | str, cadence: str) -> Column:
    """The origin period's number: its start month divided by the cadence."""
    return F.floor(month_index(date) / CADENCE_MONTHS[cadence]).cast("int")


def period_label(period: Column | str, cadence: str) -> Column:
    period = col(period)
    if cadence == "annual":
        return period.cast("string")
    return F.concat(F.floor(period / 4).cast("string"), F.lit("Q"), (F.pmod(period, F.lit(4)) + 1).cast("string"))
