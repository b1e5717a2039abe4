"""Half-even rounding of measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType, StructField

# Digits at which a double is settled before it is rounded for display.
SETTLE_DIGITS = 8


def settle(value: Column) -> Column:
    """Drop the last-bit noise that partial sums leave in a double.

    Partial aggregates arrive in any order, so the same mean can differ in its
    last bit between runs; without this a decimal tie could round either way.
    """
    return F.bround(value, SETTLE_DIGITS)


def round_half_even(value: Column, digits: int = 2) -> Column:
    return F.bround(settle(value), digits)


def quoted(name: str) -> str:
    """A column name as SQL text, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col(quoted(name))


def rounded_sql(value: str, digits: int = 2) -> str:
    """``round_half_even`` as SQL text."""
    return f"bround(bround({value}, {SETTLE_DIGITS}), {digits})"


def round_measures(df: DataFrame, digits: int = 2) -> DataFrame:
    """Round every fractional column; counts and labels stay as they are."""
    fractional = (DoubleType, FloatType, DecimalType)

    def rounded(f: StructField) -> str:
        name = quoted(f.name)
        return f"{rounded_sql(name, digits)} as {name}" if isinstance(f.dataType, fractional) else name

    return df.selectExpr(*map(rounded, df.schema.fields))
