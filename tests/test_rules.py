"""Null, zero, label, level and rounding rules on hand-made tables."""

import pytest
from pyspark.sql import functions as F

from levelwise.functions.predicates import nonzero, positive, reliability_band, visible_label
from levelwise.functions.ranks import MEDIAN, Stat, describe
from levelwise.functions.rounding import round_half_even, round_measures
from levelwise.operators import grid, shapes, tables, trends
from levelwise.roles import RoleSchema
from levelwise.sources.catalog import DatasetCatalog
from tiny import GROUP, MEASURE, TIME, cohort, rows_of


def test_zero_rules_differ_on_negatives(spark):
    df = spark.createDataFrame([(-2.0,), (0.0,), (None,), (3.0,), (float("nan"),)], "x double")
    assert rows_of(df.where(nonzero("x"))) == [(-2.0,), (3.0,)]
    assert rows_of(df.where(positive("x"))) == [(3.0,)]


def test_label_rule_hides_substrings(spark):
    labels = [("A",), (None,), ("Other",), ("another",), ("Nation",), ("n/a",), ("NA",)]
    df = spark.createDataFrame(labels, "g string")
    assert rows_of(df.where(visible_label("g"))) == [("A",), ("n/a",)]
    strict = rows_of(df.where(visible_label("g", strict=True)))
    assert strict == [("A",), ("Nation",), ("another",), ("n/a",)]


def test_bands(spark):
    df = spark.createDataFrame([(100,), (101,), (300,), (301,), (None,)], "n int")
    found = df.select("n", reliability_band("n").alias("b"))
    assert rows_of(found) == [
        (100, "low"), (101, "medium"), (300, "medium"), (301, "high"), (None, None),
    ]


def test_rounding_is_half_even_and_ignores_last_bit_noise(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (1.015,), (1.0150000000001,)], "x double")
    assert [r[0] for r in df.select(round_half_even(F.col("x"))).collect()] == [
        0.12, 0.38, 1.02, 1.02,
    ]
    mixed = spark.createDataFrame([("a", 3, 1.005)], "g string, n bigint, x float")
    assert round_measures(mixed).dtypes == [("g", "string"), ("n", "bigint"), ("x", "float")]


def test_median_is_null_when_a_value_is_missing(spark):
    c = cohort(spark, [("Q1", "A", 1.0), ("Q1", "A", None), ("Q1", "B", 1.0), ("Q1", "B", 4.0)])
    for method in ("direct", "sorted", "ranked", "split"):
        got = tables.measure_stats(c, [TIME, GROUP], MEASURE, [MEDIAN], method=method)
        assert rows_of(got) == [("Q1", "A", None), ("Q1", "B", 2.5)]


@pytest.mark.parametrize(
    "values, expected",
    [
        ([7.0], 7.0),
        ([1.0, 2.0, 3.0, 10.0], 4.0),
        ([1.0, 2.0, 3.0, 4.0, 100.0], 3.0),
        ([1.0, 1.0, 1.0, 2.0, 2.0, 2.0, 2.0, 9.0, 9.0, 9.0], 3.0),
    ],
)
@pytest.mark.parametrize("plan", ["direct", "sorted", "ranked", "split"])
def test_trimmed_mean_cut_points(spark, values, expected, plan):
    df = spark.createDataFrame([("k", v) for v in [*values, None]], "k string, x double")
    stats = [Stat("trimmed", "t", 0.2), Stat("trimmed", "m", 0.5), Stat("trimmed", "all", 0.0)]
    row = describe(df, ["k"], "x", stats, plan=plan).first()
    middle = sorted(values)
    half = (middle[(len(middle) - 1) // 2] + middle[len(middle) // 2]) / 2
    assert row.t == pytest.approx(expected)
    assert row.m == pytest.approx(half)
    assert row["all"] == pytest.approx(sum(values) / len(values))


def test_summary_keeps_null_groups_and_negatives(spark):
    c = cohort(
        spark,
        [("Q1", "A", -2.0), ("Q1", "A", 0.0), ("Q1", None, 3.0), (None, "A", 5.0), ("Q2", "A", 0.0)],
    )
    assert rows_of(tables.summary(c, TIME, MEASURE, GROUP)) == [
        ("Q1", "A", -2.0, -2.0, -2.0, 1),
        ("Q1", None, 3.0, 3.0, 3.0, 1),
        (None, "A", 5.0, 5.0, 5.0, 1),
    ]
    signed = tables.summary(c, TIME, MEASURE, signed=True)
    assert ("Q1", 0.33, 0.0, 0.33, 3) in rows_of(signed)


def test_surplus_is_signed_without_being_told(spark):
    c = cohort(spark, [("Q1", 0.0), ("Q1", -4.0)], (TIME, "Surplus"), ["string", "double"])
    assert rows_of(tables.summary(c, TIME, "Surplus")) == [("Q1", -2.0, -2.0, -2.0, 2)]
    assert rows_of(trends.trend(c, TIME, "Surplus")) == [("Q1", -2.0, -2.0, 2)]


def test_filter_keeps_levels_and_never_stacks(spark, tmp_path):
    path = str(tmp_path / "d")
    cohort(spark, [("Q1", "A", 1.0), ("Q2", "B", 2.0), ("Q2", None, 3.0)]).df.write.parquet(path)
    catalog = DatasetCatalog(spark, {"Raw": path, "Imputed": path})
    kept = catalog.cohort("Raw", GROUP, ["A"])
    assert kept.df.count() == 1
    assert catalog.cohort("Raw", GROUP, []).df.count() == 3
    assert catalog.cohort("Raw", GROUP, ["B"]).df.count() == 1
    assert catalog.reset().df.count() == 3
    assert catalog.dataset("anything").df.count() == 3
    freq = rows_of(tables.freq_table(kept, TIME, GROUP))
    # Calendar quarters are all levels, and the removed group is still a level.
    assert freq == [
        ("Q1", "A", 1), ("Q1", "B", 0), ("Q2", "A", 0), ("Q2", "B", 0),
        ("Q3", "A", 0), ("Q3", "B", 0), ("Q4", "A", 0), ("Q4", "B", 0),
    ]
    # No missing label is left after the filter, so it gets no column.
    assert tables.crosstab(kept, TIME, GROUP).columns == [
        TIME, "A_percent", "B_percent", "A", "B",
    ]


def test_stored_levels_replace_the_counting_job(spark, tmp_path):
    from levelwise.sources.catalog import write_levels

    data, levels = str(tmp_path / "d"), str(tmp_path / "l")
    c = cohort(spark, [("Q1", "A", 1.0), ("Q1", "B", 2.0), ("Q2", None, 3.0)])
    c.df.write.parquet(data)
    write_levels(c, levels)
    stored = DatasetCatalog(spark, {"Raw": data}, stored_levels={"Raw": levels}).dataset("Raw")
    assert stored.book.levels(GROUP) == ("A", "B") and stored.book.has_null(GROUP)
    assert stored.book.largest_group([TIME, GROUP]) == 1
    assert rows_of(tables.crosstab(stored, TIME, GROUP))[0] == (
        "Q1", 50.0, 50.0, 0.0, 1, 1, 0,
    )
    with pytest.raises(ValueError):
        write_levels(c.keep(GROUP, ["A"]), levels)


def test_crosstab_zero_row_and_null_column(spark):
    c = cohort(
        spark, [("Q1", "A", 1.0), ("Q1", None, 1.0), ("Q1", None, 1.0)], declared={TIME: ["Q1", "Q2"]}
    )
    assert rows_of(tables.crosstab(c, TIME, GROUP)) == [
        ("Q1", 33.33, 66.67, 1, 2),
        ("Q2", None, None, 0, 0),
    ]
    assert tables.crosstab(c, TIME, GROUP, r_names=True).columns == [
        TIME, "A.Percent", "X.NA..Percent", "A", "X.NA.",
    ]


def test_crosstab_two_groups_completes_null_rows(spark):
    rows = [("Q1", None, "x"), ("Q2", "A", "y")]
    columns = (TIME, GROUP, "Demographic_H")
    c = cohort(spark, rows, columns, declared={TIME: ["Q1", "Q2"]})
    assert rows_of(tables.crosstab(c, TIME, GROUP, "Demographic_H")) == [
        ("Q1", "A", None, None, 0, 0),
        ("Q1", None, 100.0, 0.0, 1, 0),
        ("Q2", "A", 0.0, 100.0, 0, 1),
        ("Q2", None, None, None, 0, 0),
    ]
    with pytest.raises(ValueError):
        tables.crosstab(c, TIME, GROUP, GROUP)


def test_level_names_with_odd_characters(spark):
    c = cohort(spark, [("Q1", "75+ `x`", 1.0), ("Q1", "a.b c", 1.0)], declared={TIME: ["Q1"]})
    table = tables.crosstab(c, TIME, GROUP)
    assert table.columns == [TIME, "75+ `x`_percent", "a.b c_percent", "75+ `x`", "a.b c"]
    assert rows_of(table.toDF("t", "p", "q", "a", "b")) == [("Q1", 50.0, 50.0, 1, 1)]


@pytest.mark.parametrize(
    "label, name",
    [("75+", "X75."), ("a b-c", "a.b.c"), (None, "X.NA."), ("if", "if."), (".5", "X.5"), (".a", ".a")],
)
def test_r_names(label, name):
    assert tables.r_name(label) == name


def test_latest_bar_uses_the_last_level_not_the_last_row(spark):
    rows = [("Q1", "A", 1.0), ("Q4", "B", 2.0), ("Q4", "Other", 9.0), ("Q4", "B", 4.0)]
    c = cohort(spark, rows, declared={TIME: ["Q1", "Q2", "Q3", "Q4"]})
    assert rows_of(trends.latest_bar(c, TIME, [GROUP], MEASURE)) == [("Q4", "B", 3.0, 3.0, 2)]
    assert trends.latest_bar(c.keep(GROUP, ["A"]), TIME, [GROUP], MEASURE).count() == 0


def test_trend_compares_only_when_rows_differ(spark):
    c = cohort(spark, [("Q1", "A", 1.0), ("Q1", "B", 3.0), ("Q2", "A", 0.0)])
    same = trends.trend(c, TIME, MEASURE, baseline=c)
    assert same.columns == [TIME, "mean", "median", "n"]
    both = trends.trend(c.keep(GROUP, ["A"]), TIME, MEASURE, baseline=c)
    assert rows_of(both) == [
        ("Num_X: All", "Q1", 2.0, 2.0, 2),
        ("Num_X: Filtered", "Q1", 1.0, 1.0, 1),
    ]


def test_overall_series_includes_hidden_groups(spark):
    c = cohort(spark, [("Q1", "A", 1.0), ("Q1", "Other", 3.0), ("Q1", None, 5.0)])
    assert rows_of(trends.trend_by_group(c, TIME, GROUP, MEASURE)) == [
        ("Q1", "A", 1.0, 1.0, 1),
        ("Q1", "All", 3.0, 3.0, 3),
    ]


def test_group_called_all_stays_apart_from_the_overall_series(spark):
    c = cohort(spark, [("Q1", "All", 1.0), ("Q1", "B", 3.0)])
    assert rows_of(trends.trend_by_group(c, TIME, GROUP, MEASURE)) == [
        ("Q1", "All", 1.0, 1.0, 1),
        ("Q1", "All", 2.0, 2.0, 2),
        ("Q1", "B", 3.0, 3.0, 1),
    ]


def test_area_counts_zeros_by_default(spark):
    rows = [("x Q1", "A", 0.0), ("x Q1", "A", 4.0), ("x Q2", "A", None), ("x Q2", "A", 2.0)]
    c = cohort(spark, rows, ("Year_Quarter", GROUP, MEASURE))
    assert rows_of(trends.area_mean(c, GROUP, MEASURE)) == [
        ("x Q1", "A", 2.0, 2.0, 2),
        ("x Q2", "A", 2.0, None, 2),
    ]
    assert rows_of(trends.area_mean(c, GROUP, MEASURE, measure_rule="positive")) == [
        ("x Q1", "A", 4.0, 4.0, 1),
        ("x Q2", "A", 2.0, 2.0, 1),
    ]


def test_share_empties_a_time_that_lacks_a_group(spark):
    rows = [("t1", "A"), ("t1", "A"), ("t1", "B"), ("t2", "A"), ("t2", "Other"), ("t3", "Other")]
    c = cohort(spark, rows, ("Year_Quarter", GROUP))
    assert rows_of(trends.share_area(c, GROUP)) == [
        ("t1", "A", 66.67, 3),
        ("t1", "B", 33.33, 3),
        ("t2", "A", None, None),
        ("t2", "B", None, None),
    ]
    assert rows_of(trends.share_area(c, GROUP, fill=True))[2:] == [
        ("t2", "A", 100.0, 1),
        ("t2", "B", 0.0, 1),
    ]


def test_stack_puts_the_first_level_on_top(spark):
    c = cohort(spark, [("Q1", "A", 1.0), ("Q1", "B", 2.0), ("Q2", "B", 5.0)])
    means = trends.area_mean(c, GROUP, MEASURE, time=TIME)
    assert rows_of(trends.stack(means, c, TIME, GROUP), TIME, GROUP, "ymin", "ymax") == [
        ("Q1", "A", 2.0, 3.0),
        ("Q1", "B", 0.0, 2.0),
        ("Q2", "B", 0.0, 5.0),
    ]


def test_order_follows_levels_with_missing_last(spark):
    c = cohort(
        spark,
        [("Jan", None, 1.0), ("Apr", "B", 1.0), ("Jan", "A", 1.0), (None, "A", 1.0)],
        ("Month", GROUP, MEASURE),
        declared={"Month": ["Apr", "Jan"]},
    )
    result = tables.in_level_order(tables.group_count(c, ["Month", GROUP]), c, ["Month", GROUP])
    assert [tuple(r)[:2] for r in result.collect()] == [
        ("Apr", "B"), ("Jan", "A"), ("Jan", None), (None, "A"),
    ]


def test_roles(spark):
    df = spark.range(1).selectExpr(
        "id as Row_ID", "'a' as Month", "'b' as Demographic_A", "'c' as Demographic_Event_Number",
        "1D as Num_A", "2D as Num_B", "'z' as Year_Quarter",
    )
    roles = RoleSchema.infer(df)
    assert roles.times == ("Month", "Year_Quarter")
    assert roles.second_groups == ("Demographic_Event_Number", "Demographic_A")
    assert roles.area_groups == ("Demographic_A",)
    assert roles.second_measures == ("Num_B", "Num_A")
    assert "Row_ID" not in roles.filterable and "Month" in roles.filterable
    with pytest.raises(ValueError):
        roles.require("Row_ID", "group")


def test_level_book_refuses_ids(spark):
    from levelwise.levels import LevelBook

    df = spark.range(50).selectExpr("cast(id as string) as g", "'x' as h")
    book = LevelBook(df, max_levels=10)
    with pytest.raises(ValueError):
        book.load("g", "h")
    assert LevelBook(df, max_levels=10).levels("h") == ("x",)


def test_sample_is_complete_cases_and_reproducible(spark):
    rows = [(i, "A" if i % 3 else None, float(i), float(-i) if i % 5 else None) for i in range(90)]
    columns = ("Row_ID", GROUP, "Num_A", "Num_B")
    c = cohort(spark, rows, columns, ["bigint", "string", "double", "double"])
    one = shapes.scatter_sample(c, GROUP, "Num_A", "Num_B", key="Row_ID", size=20)
    again = cohort(spark, rows[::-1], columns, ["bigint", "string", "double", "double"])
    two = shapes.scatter_sample(again, GROUP, "Num_A", "Num_B", key="Row_ID", size=20)
    assert rows_of(one) == rows_of(two) and one.count() == 20
    every = shapes.scatter_sample(c, GROUP, "Num_A", "Num_B", size=1000)
    assert every.count() == sum(1 for r in rows if r[1] and r[3] is not None)


def test_sample_over_many_tasks_is_the_same(spark, monkeypatch):
    from levelwise.plans import bounds

    rows = [(i, "A", float(i), float(-i)) for i in range(3000)]
    columns = ("Row_ID", GROUP, "Num_A", "Num_B")
    c = cohort(spark, rows, columns, ["bigint", "string", "double", "double"])
    whole = rows_of(shapes.scatter_sample(c, GROUP, "Num_A", "Num_B", key="Row_ID", size=50))
    monkeypatch.setattr(bounds, "ONE_TASK_ROWS", 10)
    cut = shapes.scatter_sample(c, GROUP, "Num_A", "Num_B", key="Row_ID", size=50)
    assert rows_of(cut) == whole and len(whole) == 50
    assert shapes.scatter_sample(c, GROUP, "Num_A", "Num_B", size=50).distinct().count() == 50
    # Too few rows below the limit: nothing is lost.
    monkeypatch.setattr(shapes.math, "sqrt", lambda _: -4.9)
    few = shapes.scatter_sample(c, GROUP, "Num_A", "Num_B", key="Row_ID", size=50)
    assert rows_of(few) == whole


def test_linear_trend_of_a_known_line(spark):
    points = spark.createDataFrame(
        [("a", float(x), 2.0 * x + 1) for x in range(5)] + [("b", 1.0, 1.0)],
        "g string, x double, y double",
    )
    a, b = shapes.linear_trend(points, "g", "x", "y").orderBy("g").collect()
    assert (a.slope, a.intercept, a.n) == (pytest.approx(2), pytest.approx(1), 5)
    assert (a.x_min, a.x_max, a.fit_min, a.fit_max) == (0, 4, pytest.approx(1), pytest.approx(9))
    assert b.slope is None and b.n == 1


def test_grid_filter_and_search(spark):
    df = spark.createDataFrame(
        [("Apple", 1, 2.5), ("pear", 5, 10.0), (None, 9, None)], "g string, n bigint, x double"
    )
    assert rows_of(grid.grid_filter(df, {"n": (2, 5)})) == [("pear", 5, 10.0)]
    assert rows_of(grid.grid_filter(df, {"g": "APP"})) == [("Apple", 1, 2.5)]
    assert rows_of(grid.grid_filter(df, {"g": ["pear", "fig"], "n": (None, 9)}), "g") == [("pear",)]
    assert rows_of(grid.grid_search(df, "2.5"), "g") == [("Apple",)]
    assert rows_of(grid.grid_search(df, "10"), "g") == [("pear",)]
    assert rows_of(grid.grid_page(df, ["n"], page=2, size=2), "n") == [(9,)]
    assert rows_of(grid.top_k(df, "n", 2), "n") == [(5,), (9,)]


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [('say "hi", you', 1, 2.5), ("b", 2, None), (None, 3, 0.0)], "g string, n bigint, x double"
    )
    path = str(tmp_path / grid.export_name("Num_X"))
    grid.export_csv(df, path)
    assert rows_of(grid.read_export(df, path)) == rows_of(df)
    text = spark.read.text(path)
    assert text.where(F.col("value") == '"g","n","x"').count() >= 1
    assert text.where(F.col("value").contains("NA")).count() == 2
    numbered = str(tmp_path / "numbered")
    grid.export_csv(df, numbered, row_number_by=["n"])
    assert [r.row for r in spark.read.csv(numbered, header=True).orderBy("row").collect()] == list("123")
    assert grid.export_name("Demographic_G", scatter=True) == "Demographic_G_scatter_data.csv"
