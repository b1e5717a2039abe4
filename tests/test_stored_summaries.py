"""Count cubes and quantile sketches: same answers, rows not read."""

import re

import numpy as np
import pytest

import __spark_entry__ as contract
from levelwise.operators import tables, trends
from levelwise.plans.inspect import plan_text
from levelwise.sources.cube import CountCube, with_cube, write_cube
from levelwise.sources.sketches import approximate_quantiles, checked_quantiles, rank_error, write_sketches
from tiny import GROUP, MEASURE, TIME, cohort, rows_of

Q, SEG, STATUS, REGION, PRIORITY = (
    contract.QUARTER, contract.SEGMENT, contract.STATUS, contract.REGION, contract.PRIORITY,
)


@pytest.fixture(scope="module")
def raw(spark, data):
    return contract._raw(spark, data)


@pytest.fixture(scope="module")
def counted(spark, raw, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cube") / "cube")
    write_cube(raw, path, contract.CUBE_VIEWS)
    return with_cube(raw, CountCube(spark, path))


def same(a, b):
    assert a.columns == b.columns and rows_of(a) == rows_of(b)


def files_read(df):
    return set(re.findall(r"(view-\d+|\w+\.parquet)\]", plan_text(df)))


def test_count_tables_from_the_cube(raw, counted):
    same(tables.group_count(counted, [Q, SEG]), tables.group_count(raw, [Q, SEG]))
    for keep in (lambda c: c, lambda c: c.keep(REGION, ["ASIA"]), lambda c: c.keep(REGION, ["ASIA"]).keep(STATUS, ["F", "O"])):
        a, b = keep(counted), keep(raw)
        same(tables.complete_counts(a, [Q, SEG]), tables.complete_counts(b, [Q, SEG]))
        same(tables.freq_table(a, Q, SEG), tables.freq_table(b, Q, SEG))
        same(tables.crosstab(a, Q, SEG, STATUS), tables.crosstab(b, Q, SEG, STATUS))
        same(tables.row_percent(a, Q, SEG), tables.row_percent(b, Q, SEG))
        same(trends.share_area(a, SEG, time=Q), trends.share_area(b, SEG, time=Q))


def test_the_smallest_fitting_view_is_read(counted):
    assert files_read(tables.group_count(counted, [Q, SEG])) == {"view-2"}
    assert files_read(tables.group_count(counted, [Q, STATUS])) == {"view-1"}
    kept = counted.keep(REGION, ["ASIA"])
    assert files_read(tables.crosstab(kept, Q, SEG)) == {"view-0"}
    # A column that no view has: rows are read.
    assert "orders.parquet" in files_read(tables.group_count(kept, [Q, PRIORITY]))
    assert "orders.parquet" in files_read(tables.group_count(counted.keep(PRIORITY, ["1-URGENT"]), [Q]))


def test_cubes_of_other_data_are_refused(spark, counted, tmp_path):
    few = cohort(spark, [("Q1", "a", 1.0), ("Q1", None, 2.0), (None, "b", None)])
    with pytest.raises(ValueError, match="another number of rows"):
        with_cube(few, counted.cube)
    with pytest.raises(ValueError, match="whole dataset"):
        write_cube(few.keep(GROUP, ["a"]), str(tmp_path / "c"), [[TIME]])
    cube = write_cube(few, str(tmp_path / "odd"), [[TIME], [GROUP], [TIME, GROUP]])
    same(tables.group_count(with_cube(few, cube), [GROUP]), tables.group_count(few, [GROUP]))
    none = cohort(spark, [])
    assert tables.group_count(with_cube(none, write_cube(none, str(tmp_path / "none"), [[TIME]])), [TIME]).count() == 0


def test_sketches_hold_their_error(spark, raw, tmp_path):
    path, columns = str(tmp_path / "s"), [contract.FY, Q, SEG, REGION]
    write_sketches(raw, path, columns, [contract.SCORE, contract.BALANCE], "positive", fineness=64)
    sketches = spark.read.parquet(path)
    for keys, filters in (([Q, SEG], []), ([SEG], [(REGION, ["ASIA"]), (contract.FY, ["1995-96"])]), ([], [])):
        got = approximate_quantiles(sketches, columns, contract.SCORE, keys, [0.1, 0.5, 0.9], filters)
        kept = raw
        for name, levels in filters:
            kept = kept.keep(name, levels)
        if keys:
            checked = checked_quantiles(got, kept, contract.SCORE, keys, "positive", rank_error(64)).collect()
            assert checked and all(r.within for r in checked)
            # The error is one of the sketch: none at all would mean that rows were read.
            tight = checked_quantiles(got, kept, contract.SCORE, keys, "positive", 0.0).collect()
            assert filters or not all(r.within for r in tight)
        else:
            values = np.array([r[0] for r in kept.df.select(contract.SCORE).collect() if r[0] and r[0] > 0])
            for r in got.collect():
                assert r.n == len(values) and abs((values <= r.value).mean() - r.p) <= rank_error(64)
        assert "orders.parquet" not in files_read(got)


def test_small_groups_are_exact(spark, tmp_path):
    rows = [("Q1", g, float(i)) for g in ("a", None) for i in range(1, 100)] + [("Q1", "none", None), ("Q1", "none", float("nan"))]
    few = cohort(spark, rows)
    write_sketches(few, str(tmp_path / "s"), [TIME, GROUP], [MEASURE])
    got = approximate_quantiles(spark.read.parquet(str(tmp_path / "s")), [TIME, GROUP], MEASURE, [GROUP], [0.5])
    assert rows_of(got) == [("a", 0.5, 50.0, 99), (None, 0.5, 50.0, 99)]
    with pytest.raises(ValueError, match="no sketches"):
        approximate_quantiles(spark.read.parquet(str(tmp_path / "s")), [TIME], MEASURE, [GROUP])
