"""Row numbers in order over many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from levelwise.functions.numbering import numbered
from levelwise.plans.inspect import plan_text


@pytest.mark.parametrize("parts", [1, 7])
def test_numbers_follow_the_order(spark, parts):
    draw = random.Random(3)
    # A third of the rows share one key, some keys are null, and rows repeat as a whole.
    rows = [(draw.choice([5, 5, 5, None, draw.randrange(900)]), f"t{draw.randrange(50)}") for _ in range(3000)]
    df = spark.createDataFrame(rows, "k int, _range string").repartition(parts)
    got = numbered(df.withColumnRenamed("_range", "t"), [F.col("k").asc_nulls_last(), "t"]).collect()
    assert [r.row for r in sorted(got, key=lambda r: r.row)] == list(range(1, 3001))
    keys = [(r.k is None, r.k or 0, r.t) for r in sorted(got, key=lambda r: r.row)]
    assert keys == sorted((k is None, k or 0, t) for k, t in rows)


def test_nothing_to_number(spark):
    assert numbered(spark.createDataFrame([], "k int"), ["k"]).count() == 0


def test_no_window_over_everything(spark):
    df = spark.range(10_000).withColumn("h", F.xxhash64("id"))
    assert "windowspecdefinition(_range" in plan_text(numbered(df, ["h"]))
