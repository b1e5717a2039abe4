"""Column names with dots, quotes and backticks give what plain names give."""

import pytest

from levelwise.cohort import Cohort
from levelwise.levels import level_values
from levelwise.operators import compare, grid, shapes, tables, trends
from levelwise.sources.catalog import DatasetCatalog, write_levels
from tiny import rows_of

TIME, YEAR = "Financial_Quarter", "Financial_Year"
PLAIN = ["Demographic_A", "Demographic_B", "Num_X", "Num_Y"]
ODD = ["Demographic_Age.Band", "Demographic_It's `b`", "Num_X.y", "Num_`Y' \"z\""]
KINDS = ["string", "string", "double", "double"]


def _rows():
    for i in range(60):
        a = ["young", "old", "mid", None][i % 4]
        x = [float(i % 7), None, 3.5, -1.0][i % 4 if i % 5 else 0]
        yield f"Q{i % 3 + 1}", "2022-23", a, "yes" if i % 2 else "no", x, float(i)


def _cohort(spark, names) -> Cohort:
    columns = [f"{TIME} string", f"{YEAR} string"]
    columns += ["`" + n.replace("`", "``") + "` " + k for n, k in zip(names, KINDS)]
    return Cohort.of(spark.createDataFrame(list(_rows()), ", ".join(columns)))


def _queries(c: Cohort, a: str, b: str, x: str, y: str, method: str):
    yield tables.group_count(c, [TIME, a])
    yield tables.complete_counts(c, [TIME, a])
    yield tables.freq_table(c, TIME, a)
    yield tables.row_percent(c, TIME, a)
    yield tables.crosstab(c, TIME, a)
    yield tables.crosstab(c, TIME, a, b)
    yield tables.in_level_order(tables.summary(c, TIME, y, a, method=method), c, [TIME, a])
    yield trends.trend(c.keep(a, ["old"]), TIME, y, c, compare=True, method=method)
    yield trends.trend_by_group(c, TIME, a, y, method=method)
    yield trends.grouping_medians(c, TIME, a, y, method=method)
    yield trends.latest_bar(c, TIME, [a, b], y, method=method)
    area = trends.area_mean(c, a, x, TIME, method=method)
    yield trends.stack(area, c, TIME, a)
    yield trends.share_area(c, a, TIME)
    yield trends.melt(c.df.select(TIME, *map(grid.col, (x, y))), [TIME], [x, y]).drop("Condition")
    sample = shapes.scatter_sample(c, a, x, y, key=y, size=10)
    yield sample
    yield shapes.linear_trend(sample, a, x, y)
    yield shapes.density_curve(c, b, y, "2022-23", method=method)
    yield grid.grid_filter(tables.summary(c, TIME, y, a, method=method), {a: ["old"]})
    yield grid.grid_search(tables.summary(c, TIME, y, a, method=method), "old")
    yield grid.top_k(tables.group_count(c, [TIME, a]), a, 3, TIME)
    yield grid.with_bands(tables.crosstab(c, TIME, a))
    yield compare.imputation_compare(c, c, [y], a, method=method).drop("measure")
    yield compare.catalog_roles(c).drop("column_name")
    yield level_values(c.df, [a, b]).drop("dimension")


@pytest.mark.parametrize("method", ["direct", "sorted", "ranked", "split"])
def test_any_name_works(spark, method):
    found = _queries(_cohort(spark, ODD), *ODD, method)
    expected = _queries(_cohort(spark, PLAIN), *PLAIN, method)
    for i, (odd, plain) in enumerate(zip(found, expected, strict=True)):
        first, second = rows_of(odd.toDF(*plain.columns)), rows_of(plain)
        swapped = [tuple(_plain_series(v) for v in r) for r in first]
        assert swapped == second, i


def _plain_series(value):
    """A series of a trend is named after its measure."""
    return value.replace(ODD[3], PLAIN[3]) if isinstance(value, str) else value


def test_levels_out_of_date_are_counted_anew(spark, tmp_path):
    data, levels = str(tmp_path / "data"), str(tmp_path / "levels")
    first = _cohort(spark, ODD)
    first.df.write.parquet(data)
    write_levels(first, levels)
    new = first.df.limit(1).withColumns({ODD[0]: grid.F.lit("zzz"), TIME: grid.F.lit("Q9")})
    new.write.mode("append").parquet(data)
    again = DatasetCatalog(spark, {"Raw": data}, {}, stored_levels={"Raw": levels}).dataset("Raw")
    assert again.book.last(TIME) == "Q9"
    assert "zzz" in tables.crosstab(again, TIME, ODD[0]).columns
