"""Cohorts over the order tables: an analysis table per order and per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levelwise.functions.fiscal import fiscal_columns
from levelwise.functions.ranks import settled_average
from levelwise.plans.bounds import attach
from levelwise.roles import ORIGINAL_PREFIX
from levelwise.sources.catalog import IMPUTED, RAW, DatasetCatalog
from levelwise.sources.scratch import checkpointed


def _segment() -> Column:
    """Market segment with missing and catch-all labels."""
    return F.when(
        F.col("c_custkey") % 13 != 0,
        F.when(F.col("c_custkey") % 11 == 0, "Other").otherwise(F.col("c_mktsegment")),
    )


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_orders(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order, with gaps in the score.

    No join carries a hint: Spark broadcasts a dimension only where its file is
    within ``spark.sql.autoBroadcastJoinThreshold``.
    """
    key = F.col("o_orderkey")
    score = F.when(
        key % 10 == 0, F.lit(0.0)
    ).otherwise(F.when(key % 17 != 0, F.col("o_totalprice")))
    joined = (
        _table(spark, folder, "orders")
        .join(_table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(_table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(_table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.select(
        key.alias("Row_ID"),
        F.col("c_custkey").alias("unique_id"),
        *[c.alias(name) for name, c in fiscal_columns("o_orderdate").items()],
        _segment().alias("Demographic_Segment"),
        F.col("o_orderpriority").alias("Demographic_Priority"),
        F.col("o_orderstatus").alias("Demographic_Status"),
        F.col("r_name").alias("Demographic_Region"),
        F.col("n_name").alias("Demographic_Nation"),
        F.col("o_totalprice").alias("Num_Price"),
        F.col("c_acctbal").alias("Num_Balance"),
        score.alias("Num_Score"),
    )


def imputed_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Raw orders with a missing score replaced by its priority's mean score.

    ``_raw_Num_Score`` has the score as it was.
    """
    raw = raw_orders(spark, folder)
    means = raw.groupBy("Demographic_Priority").agg(settled_average("Num_Score").alias("_mean"))
    # Stored, so that every later pass fills in the same values; counted, so
    # that it is broadcast only while it is small.
    means = checkpointed(means)
    filled = attach(raw, means, ["Demographic_Priority"], means.count(), how="left")
    score = F.coalesce("Num_Score", "_mean").alias("Num_Score")
    kept = [score if c == "Num_Score" else c for c in raw.columns]
    return filled.select(*kept, F.col("Num_Score").alias(f"{ORIGINAL_PREFIX}Num_Score"))


def line_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line, dated by shipment."""
    joined = (
        _table(spark, folder, "lineitem")
        .join(_table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(_table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    )
    return joined.select(
        F.col("l_orderkey").alias("Row_ID"),
        *[c.alias(name) for name, c in fiscal_columns("l_shipdate").items()],
        _segment().alias("Demographic_Segment"),
        F.col("l_returnflag").alias("Demographic_ReturnFlag"),
        F.col("l_linestatus").alias("Demographic_LineStatus"),
        F.col("l_quantity").alias("Num_Quantity"),
        F.col("l_extendedprice").alias("Num_ExtPrice"),
        F.col("l_discount").alias("Num_Discount"),
        F.col("l_tax").alias("Num_Tax"),
    )


def order_catalog(spark: SparkSession, folder: str) -> DatasetCatalog:
    return DatasetCatalog(
        spark,
        {
            IMPUTED: lambda: imputed_orders(spark, folder),
            RAW: lambda: raw_orders(spark, folder),
        },
        # Dimension keys are unique, so a cohort has at most one row per order.
        rows=_table(spark, folder, "orders").count(),
    )


def line_catalog(spark: SparkSession, folder: str) -> DatasetCatalog:
    def build() -> DataFrame:
        return line_episodes(spark, folder)

    return DatasetCatalog(
        spark,
        {IMPUTED: build, RAW: build},
        rows=_table(spark, folder, "lineitem").count(),
    )
