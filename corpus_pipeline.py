"""A corpus made ready for training in five stages.

Each stage works on all documents its predecessor kept. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from levelwise.sources.scratch import scratch_path
from levelwise.llm.decontaminate import keep_clean
from levelwise.llm.lines import drop_repeats
from levelwise.llm.packing import pack
from levelwise.llm.quality import keep_good
from levelwise.llm.simhash import keep_one


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeats(docs)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, with_text=True)


STAGES = [
    ("quality rules", _quality),
    ("line dedup", _lines),
    ("near-duplicates", _near_duplicates),
    ("decontamination", _decontamination),
    ("packing", _packing),
]

# Fingerprints and fuzzy links have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""

    def step(docs: DataFrame, stage) -> DataFrame:
        name, function = stage
        path = scratch_path(spark, name.replace(" ", "-"))
        function(spark, docs, sf_dir).write.parquet(path)
        return spark.read.parquet(path)

    return reduce(step, STAGES, spark.read.parquet(f"{sf_dir}/documents.parquet"))
