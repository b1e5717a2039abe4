"""Archives are read by as many tasks as their bytes call for."""

from pyspark.sql import functions as F

from levelwise.llm import warc
from levelwise.sources.scratch import scratch_path


def test_reads_are_dealt_by_bytes(spark, data, monkeypatch):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    folder = scratch_path(spark, "warc")
    index = warc.write_archives(pages, folder)
    total = index.agg(F.sum("length")).first()[0]
    monkeypatch.setattr(warc, "TASK_BYTES", total // 20)
    monkeypatch.setattr(warc, "LEAST_BYTES", 1 << 10)
    read = warc.read_records(index, folder)
    by_task = read.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert read.rdd.getNumPartitions() in (20, 21) and len(by_task) > 12
    assert sum(r.n for r in by_task) == index.count()
    assert max(r.n for r in by_task) < index.count() / 3
