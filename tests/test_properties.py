"""Relations between results on the whole tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from levelwise.operators import shapes, tables, trends

Q, SEG, STATUS, SCORE = contract.QUARTER, contract.SEGMENT, contract.STATUS, contract.SCORE


@pytest.fixture(scope="module")
def raw(spark, data):
    return contract._raw(spark, data)


def test_crosstab_percentages_add_up(raw):
    table = tables.crosstab(raw, Q, SEG, STATUS)
    percents = [c for c in table.columns if c.endswith("_percent")]
    total = sum((F.col(f"`{c}`") for c in percents[1:]), F.col(f"`{percents[0]}`"))
    assert table.where(F.abs(total - 100) > 0.01 * len(percents)).count() == 0


def test_frequencies_add_up_to_rows_with_labels(raw):
    freq = tables.freq_table(raw, Q, SEG).agg(F.sum("freq")).first()[0]
    assert freq == raw.df.where(F.col(SEG).isNotNull()).count()


def test_overall_count_covers_shown_groups(raw):
    rows = trends.trend_by_group(raw, Q, SEG, SCORE)
    wide = rows.groupBy(Q).agg(
        F.sum(F.when(F.col(SEG) == "All", F.col("n"))).alias("all"),
        F.sum(F.when(F.col(SEG) != "All", F.col("n"))).alias("groups"),
    )
    assert wide.where("all < groups").count() == 0


def test_filled_shares_sum_to_hundred(raw):
    shares = trends.share_area(raw, SEG, fill=True).groupBy("Time").agg(F.sum("Percentage").alias("p"))
    assert shares.where("abs(p - 100) > 0.05").count() == 0


def test_density_integrates_to_about_one(raw):
    curve = shapes.density_curve(raw, STATUS, SCORE, contract.DENSITY_YEAR)
    ends = curve.groupBy(STATUS).agg(
        F.count(F.lit(1)).alias("points"),
        ((F.max("x") - F.min("x")) / 511 * F.sum("density")).alias("area"),
    )
    for row in ends.collect():
        # The curve stops at the data's ends, where a kernel still has some mass.
        assert row.points == 512 and 0.8 < row.area < 1.01


def test_density_equals_direct_kernel_sum(spark, raw):
    import numpy as np

    rows = shapes.density_rows(raw, STATUS, SCORE, contract.DENSITY_YEAR)
    widths = {r[STATUS]: r.h for r in shapes.density_bandwidth(raw, rows, STATUS, SCORE).collect()}
    values = rows.where(F.col(STATUS) == "F").toPandas()[SCORE].to_numpy()
    curve = shapes.density_curve(raw, STATUS, SCORE, contract.DENSITY_YEAR)
    got = curve.where(F.col(STATUS) == "F").orderBy("point").toPandas()
    h = widths["F"]
    z = (got.x.to_numpy()[:, None] - values[None, :]) / h
    want = np.exp(-0.5 * z * z).sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi))
    assert np.abs(got.density.to_numpy() - want).max() < 2e-3 * want.max()


def test_sample_size_and_subset(raw):
    sample = shapes.scatter_sample(raw, SEG, contract.BALANCE, SCORE, key="Row_ID")
    assert sample.count() <= 1000
    assert sample.join(raw.df, "Row_ID", "left_anti").count() == 0


def test_empty_year_has_no_density(raw):
    assert shapes.density_curve(raw, STATUS, SCORE, "1900-01").count() == 0
