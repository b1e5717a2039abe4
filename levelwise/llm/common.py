"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levelwise.sources.scratch import scratch_path

# The six ASCII blanks: the fixed rule of what parts two words.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(column: Column | str) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for an empty one."""
    return F.array_remove(F.split(text, BLANKS, -1), "")


def ascii_lower(text: Column) -> Column:
    """``text`` with A to Z lower-cased and no other letter touched."""
    return F.translate(text, UPPER, LOWER)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder, with ``options`` of the writer, and read again.

    It is computed once, whatever executors are lost later, and its size is known
    to Spark, which then broadcasts it only below its own byte threshold.
    """
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, **options)
    return spark.read.schema(df.schema).parquet(path)


def identity(*columns: str) -> Column:
    """One number for a row's contents; a repeated row has the same one."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Pieces of an Arrow batch, so that few values are Python objects at a time."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
