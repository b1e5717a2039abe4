"""Row numbers in order, without gathering all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from levelwise.functions.rounding import col
from levelwise.plans.bounds import attach
from levelwise.sources.scratch import scratch_path

_PART, _AHEAD = "_range", "_ahead"


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "row") -> DataFrame:
    """``df`` with a leading column ``name``: 1, 2, 3 and so on in the given order.

    Rows are range-partitioned by the order and written; a second pass adds to the place in a range the rows of
    the ranges before it. Rows equal in the order are told apart by their contents, so one value that a third
    of all rows share is cut into ranges too. Of the ranges, as many as there are tasks, only sizes reach the driver.
    """
    spark = df.sparkSession
    keys = [k if isinstance(k, Column) else col(k) for k in order]
    rest = F.xxhash64(*map(col, df.columns))
    ranged = df.repartitionByRange(*keys, rest).withColumn(_PART, F.spark_partition_id())
    path = scratch_path(spark, "ranges")
    ranged.write.parquet(path)
    # Which rows share a range is fixed from here on, whatever is computed anew.
    ranged = spark.read.schema(ranged.schema).parquet(path)
    sizes = sorted(ranged.groupBy(_PART).agg(F.count(F.lit(1))).collect())
    ahead, before = [], 0
    for part, size in sizes:
        ahead.append((part, before))
        before += size
    starts = spark.createDataFrame(ahead, f"{_PART} int, {_AHEAD} long")
    placed = attach(ranged, starts, [_PART], len(ahead))
    within = F.row_number().over(W.partitionBy(_PART).orderBy(*keys, rest))
    return placed.select((F.col(_AHEAD) + within).alias(name), *map(col, df.columns))
