"""A level dictionary kept up file by file as a stored dataset grows and changes.

The manifest holds the label counts of every data file, under the file's path, length and time of change. To bring it
up to date only files it does not know are read; counts of files that are gone, or were written anew under the
same name, no longer count. So a change that leaves the number of rows as it was is seen as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelwise.functions.rounding import col
from levelwise.sources.scratch import checkpointed

_FILE = ["path", "length", "changed"]
_ROW = "path string, length long, changed timestamp, dimension string, level string, n long"


def data_files(spark: SparkSession, dataset: str) -> DataFrame:
    """``path``, ``length`` and ``changed`` of the parquet files of a dataset; their contents are not read."""
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", True)
        .load(dataset)
    )
    return listed.select(F.col("_metadata.file_path").alias("path"), "length", F.col("modificationTime").alias("changed"))


def _known(spark: SparkSession, manifest: str) -> DataFrame:
    try:
        return spark.read.schema(_ROW).parquet(f"{manifest}/batch=*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        # The manifest is not there yet.
        return spark.createDataFrame([], _ROW)


def refresh_levels(spark: SparkSession, dataset: str, manifest: str, columns: Sequence[str]) -> int:
    """Count the labels of files that are new since the last call; returns how many these are.

    A dataset stored by year keeps its year in the folders' names; it is a column like any other. One
    call at a time may write a manifest. The names of new files reach the driver, their rows do not.
    """
    files = data_files(spark, dataset)
    known = _known(spark, manifest).select(*_FILE).distinct()
    new = checkpointed(files.join(known, _FILE, "left_anti"))
    paths = [r.path for r in new.select("path").collect()]
    if not paths:
        return 0
    rows = spark.read.option("basePath", dataset).parquet(*paths)
    pairs = [F.struct(F.lit(c).alias("dimension"), col(c).cast("string").alias("level")) for c in columns]
    counted = (
        rows.select(F.col("_metadata.file_path").alias("file"), F.inline(F.array(*pairs)))
        .groupBy("file", "dimension", "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # A file without rows stands in the manifest too, with no level to count.
    named = new.join(counted, F.col("path") == F.col("file"), "left").select(*_FILE, "dimension", "level", "n")
    batch = known.agg(F.count(F.lit(1))).first()[0]
    named.write.mode("overwrite").parquet(f"{manifest}/batch={batch}")
    return len(paths)


def kept_levels(spark: SparkSession, dataset: str, manifest: str) -> DataFrame:
    """(dimension, level, n) over the files the dataset has now, as ``Cohort.over`` takes stored levels."""
    files = data_files(spark, dataset)
    now = _known(spark, manifest).join(files, _FILE, "left_semi").where("dimension is not null")
    return now.groupBy("dimension", "level").agg(F.sum("n").alias("n"))
