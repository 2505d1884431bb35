"""Months as ``yyyy-MM-01`` strings."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_of(time: Column) -> Column:
    """First day of the month of a date, a timestamp or an ISO string."""
    return F.concat(F.left(time.cast("string"), F.lit(7)), F.lit("-01"))


def months_back(df: DataFrame, column: str, months: int, new: str = "Feature_Time", back: str = "months_back") -> DataFrame:
    """Every row once for each of ``months`` months that end with its own."""
    first = F.to_date(column)
    shifts = F.explode(F.sequence(F.lit(0), F.lit(months - 1)))
    out = df.withColumn("__from", first).select("*", shifts.alias(back))
    return out.withColumn(new, F.date_format(F.add_months("__from", -F.col(back)), "yyyy-MM-dd")).drop("__from")


def month_list(start: str, end: str) -> list[str]:
    """First days of the months from ``start`` up to before ``end`` (ISO dates)."""
    a, b = date.fromisoformat(start).replace(day=1), date.fromisoformat(end)
    out = []
    while a < b:
        out.append(a.isoformat())
        a = a.replace(year=a.year + a.month // 12, month=a.month % 12 + 1)
    return out
