"""Level counts kept up file by file."""

import pytest

from levelwise.cohort import Cohort
from levelwise.operators import tables
from levelwise.sources import manifest as m
from tiny import rows_of

KIND = "Financial_Quarter string, Demographic_G string, Demographic_N int, day int"


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "data")

    def write(rows, files=1):
        df = spark.createDataFrame(rows, KIND).repartition(files)
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)

    return path, str(tmp_path / "levels"), write


COLUMNS = ["Financial_Quarter", "Demographic_G", "Demographic_N"]


def counted(spark, path):
    df = spark.read.parquet(path)
    out = []
    for c in COLUMNS:
        out += [(c, None if k is None else str(k), n) for k, n in df.groupBy(c).count().collect()]
    return sorted(out, key=str)


def test_only_new_files_are_counted(spark, store):
    path, levels, write = store
    write([("Q1", "a", 10, 1), ("Q1", None, 9, 1), ("Q2", "b", 9, 2)])
    kept = lambda: sorted((tuple(r) for r in m.kept_levels(spark, path, levels).collect()), key=str)
    assert m.refresh_levels(spark, path, levels, COLUMNS) == 2
    assert kept() == counted(spark, path)
    assert m.refresh_levels(spark, path, levels, COLUMNS) == 0
    write([("Q3", "a", 100, 3)] * 5)
    assert m.refresh_levels(spark, path, levels, COLUMNS) == 1
    assert kept() == counted(spark, path)
    # The same number of rows with another label: no row count gives it away.
    write([("Q3", "z", 100, 3)] * 5)
    assert m.refresh_levels(spark, path, levels, COLUMNS) == 1
    assert kept() == counted(spark, path)
    cohort = Cohort.over(spark.read.parquet(path), stored=m.kept_levels(spark, path, levels))
    assert cohort.book.levels("Demographic_G") == ("a", "b", "z")
    assert cohort.book.levels("Demographic_N") == ("9", "10", "100")
    assert rows_of(tables.group_count(cohort, ["Demographic_G"])) == [("a", 1), ("b", 1), ("z", 5), (None, 1)]


def test_a_refresh_that_was_lost_is_done_again(spark, store, monkeypatch):
    path, levels, write = store
    write([("Q1", "a", 1, 1)])
    m.refresh_levels(spark, path, levels, COLUMNS)
    write([("Q2", "b", 2, 2)])
    monkeypatch.setattr(m, "checkpointed", lambda df: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        m.refresh_levels(spark, path, levels, COLUMNS)
    monkeypatch.undo()
    assert m.refresh_levels(spark, path, levels, COLUMNS) == 1
    assert sorted((tuple(r) for r in m.kept_levels(spark, path, levels).collect()), key=str) == counted(spark, path)
