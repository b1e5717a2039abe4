"""Sorted groups and level dictionaries: what one task is given does not grow with the data."""

from pyspark.sql import functions as F

from levelwise.functions import ranks
from levelwise.functions.ranks import MEDIAN, ROWS, describe
from levelwise.levels import LevelBook
from levelwise.plans import bounds


def _largest_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_sorted_rows_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(bounds, "SORTED_ROWS", 500)
    for n in (20_000, 80_000):
        rows = spark.range(n).select((F.col("id") % (n // 4)).cast("string").alias("k"), F.col("id").cast("double").alias("v"))
        table = ranks._sorted_table(rows, ["k"], False, n)
        assert _largest_task(table) < 1_000
        for plan in ("sorted", "split"):
            got = describe(rows, ["k"], "v", [MEDIAN, ROWS], plan=plan)
            assert _largest_task(got) < 300
            assert got.agg(F.count("*"), F.sum("n")).first() == (n // 4, n)


def test_groups_are_counted_in_full_buckets_only(spark, monkeypatch):
    monkeypatch.setattr(bounds, "HEAVY_ROWS", 100)
    monkeypatch.setattr(bounds, "SIZE_BUCKETS", 64)
    k = F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).otherwise((F.col("id") % 1_000).cast("string"))
    rows = spark.range(6_000).select(k.alias("k"), F.lit(1.0).alias("v"))
    heavy, total = ranks._heavy_groups(rows, ["k"])
    assert total == 6_000 and [r.k for r in heavy.collect()] == [None]
    assert ranks._heavy_groups(rows.where("k is not null").limit(90), ["k"]) == (None, 90)
    assert ranks._heavy_groups(rows.where("false"), ["k"]) == (None, 0)


def test_labels_of_an_id_are_not_counted(spark, monkeypatch):
    monkeypatch.setattr(bounds, "ONE_TASK_ROWS", 1_000)
    counted = []
    found = LevelBook._past_limit
    monkeypatch.setattr(LevelBook, "_past_limit", lambda self, columns: counted.append(columns) or found(self, columns))
    rows = spark.range(5_000).select(F.col("id").cast("string").alias("a"), (F.col("id") % 40).cast("string").alias("b"))
    book = LevelBook(rows, max_levels=50)
    assert book.largest_group(["a", "b"]) == 125 and book._wide == {"a"}
    assert counted == [["a", "b"]]
