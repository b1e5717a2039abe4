"""Physical plans: what is read, shuffled and broadcast."""

import re

import pytest

import __spark_entry__ as contract
from levelwise.operators import shapes, tables, trends
from levelwise.plans.inspect import operators, plan_text
from levelwise.sources.catalog import DatasetCatalog, write_dataset

Q, SEG, STATUS, SCORE, PRICE = (
    contract.QUARTER, contract.SEGMENT, contract.STATUS, contract.SCORE, contract.PRICE,
)


@pytest.fixture(scope="module")
def flat(spark, data, tmp_path_factory):
    """The analysis table stored by year, as a cluster would read it."""
    path = str(tmp_path_factory.mktemp("flat") / "dataset")
    write_dataset(contract._raw(spark, data).df, path)
    return DatasetCatalog(spark, {"Raw": path, "Imputed": path})


def test_summary_reads_its_columns_and_shuffles_once(flat):
    df = tables.summary(flat.dataset("Raw"), Q, PRICE, SEG)
    text = plan_text(df)
    schema = re.search(r"ReadSchema: struct<(.*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {Q, SEG, PRICE}
    assert "Not(EqualTo(Num_Price,0.0))" in text
    assert operators(df).count("Exchange") == 1
    assert "Window" not in operators(df)


def test_positive_rule_is_pushed_to_the_scan(flat):
    text = plan_text(trends.trend(flat.dataset("Raw"), Q, PRICE))
    assert "GreaterThan(Num_Price,0.0)" in text


def test_cohort_filter_is_pushed_to_the_scan(flat):
    df = tables.group_count(flat.cohort("Raw", contract.REGION, ["ASIA", "EUROPE"]), [Q])
    assert "In(Demographic_Region, [ASIA,EUROPE])" in plan_text(df)


def test_year_filter_prunes_files(flat):
    df = shapes.density_rows(flat.dataset("Raw"), STATUS, SCORE, contract.DENSITY_YEAR)
    text = plan_text(df)
    pruned = re.search(r"PartitionFilters: \[(.*)\]", text).group(1)
    assert "Financial_Year" in pruned
    # The band is known by now, so the scan skips row groups outside it.
    assert "GreaterThanOrEqual(Num_Score" in text and "LessThanOrEqual(Num_Score" in text


def test_latest_period_is_filtered_before_aggregation(flat):
    text = plan_text(trends.latest_bar(flat.dataset("Raw"), Q, [SEG], PRICE))
    assert "EqualTo(Financial_Quarter,Q4)" in text and "IsNotNull(Demographic_Segment)" in text


def test_crosstab_aggregates_before_it_pivots(flat):
    names = operators(tables.crosstab(flat.dataset("Raw"), Q, SEG))
    assert not any("Join" in n or "Cartesian" in n for n in names)
    # Grid rows join the facts before the partial aggregation.
    assert "Union" in names and names.index("Union") > names.index("Exchange")
    assert "Sort" not in names


def test_groups_and_overall_come_from_one_scan(flat):
    names = operators(trends.trend_by_group(flat.dataset("Raw"), Q, SEG, PRICE))
    assert sum(n.startswith("Scan parquet") for n in names) == 1


def scans(df):
    return sum(n.startswith("Scan parquet") for n in operators(df))


def test_filtered_and_all_come_from_one_scan(flat, spark, data):
    kept, everyone = flat.cohort("Raw", contract.REGION, ["ASIA"]), flat.dataset("Raw")
    assert scans(trends.trend(kept, Q, PRICE, everyone, compare=True)) == 1
    # A dataset that is a join of four tables: each is read once.
    assert scans(contract.queries()["trend_filtered_vs_all"](spark, data)) == 4
    # Cohorts of different datasets are still read one by one.
    assert scans(trends.trend(kept, Q, PRICE, flat.dataset("Imputed"), compare=True)) == 2


def test_both_variants_come_from_one_scan(spark, data):
    assert scans(contract.queries()["imputation_compare"](spark, data)) == 4


def test_many_groups_are_sorted_and_large_ones_cut(spark, data, monkeypatch):
    from levelwise.plans import bounds

    mixed = contract._mixed(spark, data)
    keys = [contract.FY, contract.ORDER]
    assert mixed.plan(keys) == "sorted"
    monkeypatch.setattr(bounds, "ONE_TASK_ROWS", 1000)
    assert mixed.plan(keys) == "split" and mixed.plan([contract.FY]) == "ranked"
    monkeypatch.setattr(bounds, "HEAVY_ROWS", 500)
    df = tables.summary(mixed, contract.FY, contract.QUANTITY, contract.ORDER)
    names = operators(df)
    assert scans(df) == 1
    # Quantities are whole numbers, so the bins of the heavy groups need no more rows: one scan is left.
    assert "Union" in names and not any("SortMerge" in n for n in names)


def test_sample_keeps_only_the_first_rows_of_each_task(flat):
    c = flat.dataset("Raw")
    names = operators(shapes.scatter_sample(c, SEG, contract.BALANCE, SCORE, key="Row_ID"))
    assert "TakeOrderedAndProject" in names
    assert "Exchange" not in names


def test_ranked_plan_joins_intervals_by_broadcast(flat, monkeypatch):
    df = tables.summary(flat.dataset("Raw"), Q, PRICE, SEG, method="ranked")
    names = operators(df)
    scans = [n for n in names if n.startswith("Scan parquet")]
    # Earlier passes are done; what is left reads the data once.
    assert len(scans) == 1
    assert not any("Cartesian" in n or "NestedLoop" in n or "SortMerge" in n for n in names)
    assert "partial_count(1)" in plan_text(df)


@pytest.mark.parametrize("name", sorted(contract._cohort_queries()))
def test_no_python_and_no_cross_join(spark, data, name):
    names = operators(contract.queries()[name](spark, data))
    banned = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups", "Cartesian")
    assert not [n for n in names if n.startswith(banned)]
    assert not any("NestedLoopJoin" in n for n in names)


@pytest.mark.parametrize("name", sorted(contract._cohort_queries()))
def test_windows_have_partitions(spark, data, name):
    """No window sorts everything in one task."""
    text = plan_text(contract.queries()[name](spark, data))
    for arguments in re.findall(r"\(\d+\) Window\n(?:.*\n)*?Arguments: (.*)", text):
        assert "windowspecdefinition(" in arguments
        assert not re.search(r"windowspecdefinition\([^,]*(ASC|DESC)", arguments), arguments


def test_ranked_density_reads_a_joined_cohort_once(spark, data):
    """The join was done for the stored rows of the year; nothing left reads a table."""
    names = operators(contract.queries()["density_curve_lines_ranked"](spark, data))
    assert not any(n.startswith("Scan parquet") for n in names)
