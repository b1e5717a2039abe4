"""Labels that are not text, stored level order, grids and exports past plain labels."""

import datetime

import pytest

from levelwise.levels import level_grid, level_values
from levelwise.operators import grid, tables, trends
from levelwise.sources.catalog import DatasetCatalog, write_levels
from tiny import GROUP, MEASURE, TIME, cohort, rows_of


def test_numbers_keep_their_order(spark):
    rows = [("Q1", g, 1.0) for g in (10, 2, 1, None)]
    c = cohort(spark, rows, kinds=["string", "int", "double"])
    assert c.book.levels(GROUP) == ("1", "2", "10")
    counts = [n for n in tables.crosstab(c, TIME, GROUP).columns if not n.endswith("_percent")]
    assert counts[1:4] == ["1", "2", "10"]
    assert c.keep(GROUP, [2]).df.count() == 1
    found = rows_of(trends.trend_by_group(c, TIME, GROUP, MEASURE), GROUP)
    assert found == [("1",), ("10",), ("2",), ("All",)]
    ordered = tables.in_level_order(tables.summary(c, TIME, MEASURE, GROUP), c, [TIME, GROUP])
    assert [r[GROUP] for r in ordered.collect() if r[GROUP]] == ["1", "2", "10"]


@pytest.mark.parametrize(
    "kind, low, high",
    [("boolean", False, True), ("date", datetime.date(2020, 1, 9), datetime.date(2020, 1, 10))],
)
def test_other_labels(spark, kind, low, high):
    c = cohort(spark, [("Q1", high, 1.0), ("Q1", low, 2.0)], kinds=["string", kind, "double"])
    text = [str(v).lower() for v in (low, high)]
    assert list(c.book.levels(GROUP)) == text
    assert sorted(r.Condition for r in trends.share_area(c, GROUP, TIME).collect()) == sorted(text)
    assert c.keep(GROUP, [high]).df.count() == 1


def test_listed_numbers(spark):
    df = spark.createDataFrame([(10,), (9,), (-1,)], "g int")
    assert rows_of(level_values(df, ["g"]), "level_idx", "level") == [(1, "-1"), (2, "9"), (3, "10")]


def test_order_is_stored(spark, tmp_path):
    c = cohort(
        spark,
        [("Q1", 10, 1.0), ("Q1", 9, 1.0)],
        kinds=["string", "int", "double"],
        declared={TIME: ("Q2", "Q1")},
    )
    data, levels = str(tmp_path / "data"), str(tmp_path / "levels")
    c.df.write.parquet(data)  # the labels are text there
    write_levels(c, levels)
    again = DatasetCatalog(spark, {"Raw": data}, {}, stored_levels={"Raw": levels}).dataset("Raw")
    assert again.book.levels(GROUP) == ("9", "10")


def test_share_refuses_other_columns(spark):
    c = cohort(spark, [("Q1", "a", 1.0)])
    with pytest.raises(ValueError, match="not a group"):
        trends.share_area(c, MEASURE, TIME)


def test_grid_is_bounded(spark):
    many = [str(i) for i in range(10_000)]
    with pytest.raises(ValueError, match="cells"):
        level_grid(spark, {"a": many, "b": many, "c": many})


def test_search_sees_all_decimals(spark):
    df = spark.createDataFrame([(0.1234,), (1e36,)], "x double")
    assert grid.grid_search(df, "0.1234").count() == 1
