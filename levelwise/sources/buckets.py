"""Dataset variants stored in buckets of their row id, so that they join row by row without a shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from levelwise.functions.rounding import quoted
from levelwise.sources.scratch import scratch_path


def write_buckets(
    spark: SparkSession, variants: Mapping[str, DataFrame], key: str, buckets: int, path: str | None = None
) -> dict[str, DataFrame]:
    """Store every variant with the same number of buckets, sorted by ``key``, and open it again.

    Rows are dealt by a hash of the key, which is as good as unique, so no bucket is hot. Files go to
    ``path`` (the shared folder if none is given); the tables that know of the buckets are the session's.
    """
    root = path or scratch_path(spark, "buckets")
    opened = {}
    for name, df in variants.items():
        table = f"levelwise_{uuid.uuid4().hex}"
        dealt = df.repartition(buckets, quoted(key))
        written = dealt.write.bucketBy(buckets, key).sortBy(key).format("parquet")
        written.option("path", f"{root}/{name}").saveAsTable(table)
        opened[name] = spark.table(table)
    return opened
