"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution picks the final partition count, so shuffles may start
# fine-grained; hot join keys are split by it. Labels are compared with UTC dates.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
}


def configured(
    builder: SparkSession.Builder, cores: int, waves: int = 16
) -> SparkSession.Builder:
    """``builder`` with the settings, sized for ``cores`` executor cores in all.

    A shuffle starts with ``waves`` partitions for each core and adaptive execution merges
    small ones; one wave is enough for tables of megabytes. A cluster must also set
    ``spark.checkpoint.dir`` to a shared folder.
    """
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    builder = builder.config(initial, str(max(1, cores * waves)))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.config("spark.sql.shuffle.partitions", str(max(1, cores)))
