"""Variants joined row by row from buckets, and samples read from stored rows."""

import pytest

import __spark_entry__ as contract
from levelwise.operators import compare, shapes
from levelwise.plans.inspect import operators, plan_text
from levelwise.sources.buckets import write_buckets
from levelwise.sources.samples import stored_sample, write_sample
from tiny import rows_of

SEG, REGION, BALANCE, SCORE = contract.SEGMENT, contract.REGION, contract.BALANCE, contract.SCORE


def test_buckets_join_without_a_shuffle(spark, monkeypatch, tmp_path):
    nan = float("nan")
    raw = spark.createDataFrame(
        [(1, 1.0, None), (2, None, 4.0), (3, nan, None), (4, 2.0, 6.0), (5, 3.0, 1.0)], "Row_ID long, Num_A double, Num_B double"
    )
    imputed = spark.createDataFrame(
        [(1, 1.0, 5.0), (2, 9.0, 4.0), (3, 11.0, None), (4, 2.5, 6.0), (6, 7.0, 7.0)], "Row_ID long, Num_A double, Num_B double"
    )
    stored = write_buckets(spark, {"Raw": raw, "Imputed": imputed}, "Row_ID", 4, str(tmp_path / "b"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = compare.imputation_rows(stored["Raw"], stored["Imputed"], "Row_ID", ["Num_A", "Num_B"])
        names = operators(df)
        below = names[next(i for i, n in enumerate(names) if n.startswith("SortMergeJoin")) :]
        assert "Exchange" not in below
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    found = {r.measure: r.asDict() for r in df.collect()}
    a, b = found["Num_A"], found["Num_B"]
    assert (a["n"], a["raw_only"], a["imputed_only"]) == (4, 1, 1)
    assert (a["filled"], a["missing"], a["changed"], a["filled_mean"], a["filled_sd"]) == (2, 0, 1, 10.0, 1.41)
    assert (a["observed_mean"], a["observed_sd"]) == (1.75, 1.06)
    assert (b["filled"], b["missing"], b["changed"], b["filled_mean"], b["filled_sd"]) == (1, 1, 0, 5.0, None)


@pytest.fixture(scope="module")
def stored(spark, data, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sample") / "rows")
    write_sample(contract._raw(spark, data), path, "Row_ID", [contract.FY], 500)
    return spark.read.parquet(path)


def test_stored_samples_are_the_same_rows(spark, data, stored):
    raw = contract._raw(spark, data)
    for c, size in ((raw, 1000), (raw.keep(REGION, ["ASIA"]), 200), (raw.keep(REGION, ["ASIA"]).keep(contract.STATUS, ["F"]), 50)):
        want = shapes.scatter_sample(c, SEG, BALANCE, SCORE, "Row_ID", size=size)
        got = stored_sample(c, stored, SEG, BALANCE, SCORE, "Row_ID", size=size)
        assert "orders.parquet" not in plan_text(got)
        assert got.columns == want.columns and rows_of(got) == rows_of(want)


def test_rows_are_read_where_the_stored_ones_are_too_few(spark, data, stored):
    few = contract._raw(spark, data).keep(contract.NATION, ["CHINA"])
    want = shapes.scatter_sample(few, SEG, BALANCE, SCORE, "Row_ID", size=400)
    got = stored_sample(few, stored, SEG, BALANCE, SCORE, "Row_ID", size=400)
    assert "orders.parquet" in plan_text(got) and rows_of(got) == rows_of(want)
    # A cohort cut in a way that its filters do not tell is read as well.
    from dataclasses import replace

    cut = replace(few, df=few.df.where("Row_ID % 2 = 0"), filters=())
    got = stored_sample(cut, stored, SEG, BALANCE, SCORE, "Row_ID", size=10)
    assert rows_of(got) == rows_of(shapes.scatter_sample(cut, SEG, BALANCE, SCORE, "Row_ID", size=10))


def test_a_sample_deeper_than_the_data(spark, data, tmp_path):
    raw = contract._raw(spark, data)
    write_sample(raw, str(tmp_path / "all"), "Row_ID", [contract.FY], 10**6)
    few = raw.keep(contract.NATION, ["CHINA"])
    got = stored_sample(few, spark.read.parquet(str(tmp_path / "all")), SEG, BALANCE, SCORE, "Row_ID")
    assert "orders.parquet" not in plan_text(got)
    assert rows_of(got) == rows_of(shapes.scatter_sample(few, SEG, BALANCE, SCORE, "Row_ID"))
