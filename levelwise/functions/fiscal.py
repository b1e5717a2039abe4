"""Reporting calendar with an April start, derived from one timestamp column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The label order of the closed calendar dimensions.
MONTHS = ("Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec", "Jan", "Feb", "Mar")
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
QUARTERS = ("Q1", "Q2", "Q3", "Q4")

# Level orders every calendar dataset shares, whether or not a label occurs.
CALENDAR_LEVELS = {"Month": MONTHS, "DOTW": WEEKDAYS, "Financial_Quarter": QUARTERS}


def _pick(labels: tuple[str, ...], position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in labels]), position)


def fiscal_columns(stamp: str | Column) -> dict[str, Column]:
    """The six calendar columns of a timestamp, by name."""
    ts = F.col(stamp) if isinstance(stamp, str) else stamp
    month, year = F.month(ts), F.year(ts)
    month_idx = (month + 8) % 12 + 1
    start = F.when(month < 4, year - 1).otherwise(year)
    quarter = _pick(QUARTERS, F.ceil(month_idx / 3).cast("int"))
    fiscal_year = F.concat(
        start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0")
    )
    return {
        "Month_idx": month_idx.cast("int"),
        "Month": _pick(MONTHS, month_idx),
        "Financial_Quarter": quarter,
        "Financial_Year": fiscal_year,
        "Year_Quarter": F.concat(fiscal_year, F.lit(" "), quarter),
        "DOTW": _pick(WEEKDAYS, F.weekday(ts) + 1),
    }


def with_fiscal_dims(df: DataFrame, stamp: str) -> DataFrame:
    return df.withColumns(fiscal_columns(stamp))
