"""Filtering, searching, ordering and paging a result table, and exporting it."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from levelwise.functions.numbering import numbered
from levelwise.functions.predicates import reliability_band
from levelwise.functions.rounding import col

# How exported files write a missing value and name count columns.
NA_TEXT = "NA"
COUNT_COLUMNS = ("freq", "n")
SCATTER_SUFFIX = "_scatter_data"
# Rows of a stored result that lie in one folder.
CHUNK_ROWS = 100_000


def grid_filter(result: DataFrame, conditions: Mapping[str, object]) -> DataFrame:
    """Column filters: a (low, high) range, a list of labels, or a text to find.

    Either end of a range may be None. Conditions on several columns all hold.
    """
    for name, wanted in conditions.items():
        column = col(name)
        if isinstance(wanted, tuple):
            low, high = wanted
            if low is not None:
                result = result.where(column >= low)
            if high is not None:
                result = result.where(column <= high)
        elif isinstance(wanted, list):
            result = result.where(column.isin(*wanted))
        else:
            result = result.where(F.contains(F.lower(column), F.lit(str(wanted).lower())))
    return result


def _display(df: DataFrame, name: str) -> Column:
    """A cell as the text a reader sees: no exponent, no trailing zeros, ten decimals at most.

    A number too large for that is shown as Spark writes it.
    """
    column = col(name)
    if isinstance(df.schema[name].dataType, (DoubleType, FloatType)):
        text = column.try_cast("decimal(38,10)").cast("string")
        return F.coalesce(F.regexp_replace(text, r"\.?0+$", ""), column.cast("string"))
    return column.cast("string")


def grid_search(result: DataFrame, text: str) -> DataFrame:
    """Rows in which any column contains ``text``, in any case."""
    needle = F.lit(text.lower())
    hits = [
        F.coalesce(F.contains(F.lower(_display(result, c)), needle), F.lit(False))
        for c in result.columns
    ]
    return result.where(reduce(Column.__or__, hits))


def grid_page(result: DataFrame, order: list[Column | str], page: int, size: int) -> DataFrame:
    """Page ``page`` (from 1) of ``size`` rows in the given order."""
    return result.orderBy(*order).offset((page - 1) * size).limit(size)


def write_pages(result: DataFrame, path: str, order: list[Column | str], chunk_rows: int = CHUNK_ROWS) -> None:
    """Store a result in its order, in folders of ``chunk_rows`` rows, for :func:`stored_page`.

    The order is found once, range by range. Each row keeps its number as ``_row`` and its folder as ``_chunk``.
    """
    rows = numbered(result, order, "_row")
    chunk = F.floor((F.col("_row") - 1) / chunk_rows).cast("long").alias("_chunk")
    # A chunk is of bounded size, so one task can write it.
    dealt = rows.select("*", chunk).repartition("_chunk").sortWithinPartitions("_chunk", "_row")
    dealt.write.mode("error").partitionBy("_chunk").parquet(path)


def stored_page(
    spark: SparkSession, path: str, page: int, size: int, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Page ``page`` (from 1) of a stored result; only the folders that it lies in are read."""
    first, last = (page - 1) * size + 1, page * size
    rows = spark.read.parquet(path)
    inside = rows.where(F.col("_chunk").between((first - 1) // chunk_rows, (last - 1) // chunk_rows))
    wanted = inside.where(F.col("_row").between(first, last)).orderBy("_row")
    return wanted.drop("_row", "_chunk")


def top_k(result: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    """The ``k`` rows with the largest ``by``; ``ties`` make the choice unique."""
    return result.orderBy(col(by).desc_nulls_last(), *map(col, ties)).limit(k)


def band_columns(result: DataFrame) -> list[str]:
    """Count columns a table is coloured by.

    A named count column if there is one; otherwise a crosstab's level columns,
    which are whole numbers, unlike their percentages.
    """
    named = [c for c in COUNT_COLUMNS if c in result.columns]
    if named:
        return named
    return [
        f.name
        for f in result.schema.fields
        if f.dataType.simpleString() in ("bigint", "int") and f.name != "Year"
    ]


def with_bands(result: DataFrame) -> DataFrame:
    """Add a reliability band for every count column."""
    columns = band_columns(result)
    single = len(columns) == 1
    return result.withColumns(
        {
            "band" if single else f"{c}_band": reliability_band(c)
            for c in columns
        }
    )


def export_name(column: str, scatter: bool = False) -> str:
    """File name of an exported table: one chosen column of its query."""
    return f"{column}{SCATTER_SUFFIX if scatter else ''}.csv"


def export_csv(
    result: DataFrame, path: str, row_number_by: list[str] | None = None, missing: str = NA_TEXT
) -> None:
    """Write a result as CSV: header, quoted fields with quotes doubled, ``missing`` for null.

    CSV cannot tell a missing value from a text that equals its mark: where labels may be
    "NA", give another mark here and in :func:`read_export`.

    ``row_number_by`` adds a leading row number (a long) in that order, which is also that of the files.
    """
    if row_number_by:
        result = numbered(result, row_number_by).orderBy("row")
    result.write.option("header", True).option("quoteAll", True).option("escape", '"').option(
        "nullValue", missing
    ).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).mode("error").csv(path)


def read_export(result: DataFrame, path: str, missing: str = NA_TEXT) -> DataFrame:
    """Read an exported table back with the columns of ``result``; fields may hold line breaks."""
    return (
        result.sparkSession.read.schema(result.schema)
        .option("header", True)
        .option("nullValue", missing)
        .option("emptyValue", "")
        .option("escape", '"')
        .option("multiLine", True)
        .csv(path)
    )
