"""Every registered query against its SQL on whole tables."""

import pytest

import __spark_entry__ as contract
from checking import connect, differences

# The training-data queries have tests of their own.
NAMES = sorted(contract._cohort_queries())


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


def test_every_query_has_sql():
    assert set(NAMES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, data, name):
    df = contract.queries()[name](spark, data)
    assert differences(df, duck, contract.oracle_sql()[name]) == []


def test_entry_has_rows(spark):
    df = contract.entry(spark)
    assert df.columns == [
        "Financial_Quarter", "Demographic_Segment", "mean", "median", "trimmed_mean_20", "n",
    ]
    assert df.count() > 0
