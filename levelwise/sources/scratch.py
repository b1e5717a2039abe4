"""The shared folder for files a job writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    A machine-local folder is made only where Spark runs in one process; elsewhere the
    cluster has to name a folder that all executors share.
    """
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_KEY, None) or context.getCheckpointDir()
    if not root and context.master != "local" and not context.master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="levelwise-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for files of one job."""
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed now and kept in the shared folder, without its lineage."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)
