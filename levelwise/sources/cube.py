"""A stored lattice of counts that answers count tables without reading rows.

A view holds the row counts of every label combination of some columns that occurs. The widest view is
counted from the dataset, each other one from the smallest view that has its columns. A count table of a
cohort needs its own columns and those it was filtered on; it is read from the smallest view with all of these.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelwise.cohort import Cohort
from levelwise.functions.rounding import col

_COUNT = "_n"
_INDEX = "view int, place int, name string, cells long, total long"


class CountCube:
    """Views stored under one path, opened by reading a small index of them."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path
        self._columns: dict[int, list[str]] = {}
        self._cells: dict[int, int] = {}
        self.rows = 0
        # A row for each view and column of it.
        for r in spark.read.schema(_INDEX).parquet(f"{path}/index").orderBy("view", "place").collect():
            self._columns.setdefault(r.view, []).append(r.name)
            self._cells[r.view], self.rows = r.cells, r.total

    def smallest(self, columns: Iterable[str]) -> DataFrame | None:
        """The view of fewest cells that has ``columns``, with the counts in ``_n``; None without one."""
        wanted = set(columns)
        fitting = [v for v, own in self._columns.items() if wanted <= set(own)]
        if not fitting:
            return None
        best = min(fitting, key=lambda v: (self._cells[v], v))
        return self._spark.read.parquet(f"{self._path}/view-{best}").toDF(*self._columns[best], _COUNT)

    def counts(self, columns: Sequence[str], filters: Sequence[tuple[str, tuple]]) -> DataFrame | None:
        """Rows of ``columns`` and ``n`` for what the filters leave; several rows may share labels."""
        view = self.smallest([*columns, *(c for c, _ in filters)])
        if view is None:
            return None
        for name, levels in filters:
            view = view.where(col(name).isin(*levels))
        return view.select(*map(col, columns), F.col(_COUNT).alias("n"))


def write_cube(cohort: Cohort, path: str, views: Sequence[Sequence[str]]) -> CountCube:
    """Count an unfiltered cohort by every set of columns in ``views`` and store the counts.

    Columns must be categorical. A missing label is one like any other. A view that has all columns
    of the others spares them the dataset.
    """
    if cohort.filtered:
        raise ValueError("a cube belongs to the whole dataset, not to a filtered cohort")
    spark = cohort.df.sparkSession
    done: list[tuple[int, list[str], int]] = []
    index, total = [], None
    for number, columns in enumerate(sorted((list(dict.fromkeys(v)) for v in views), key=len, reverse=True)):
        for c in columns:
            cohort.roles.require(c, "categorical")
        above = [d for d in done if set(columns) <= set(d[1])]
        if above:
            parent = min(above, key=lambda d: d[2])
            source = spark.read.parquet(f"{path}/view-{parent[0]}").toDF(*parent[1], _COUNT)
        else:
            source = cohort.df.withColumn(_COUNT, F.lit(1).cast("long"))
        counted = source.groupBy(*map(col, columns)).agg(F.sum(_COUNT).alias(_COUNT))
        # Files name columns by place, as labels of the model may be any text.
        counted.toDF(*[f"c{i}" for i in range(len(columns))], _COUNT).write.parquet(f"{path}/view-{number}")
        stored = spark.read.parquet(f"{path}/view-{number}")
        cells, rows = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum(_COUNT), F.lit(0))).first()
        total = rows if total is None else total
        if rows != total:
            raise RuntimeError("the dataset changed while it was counted")
        done.append((number, columns, cells))
        index += [(number, i, c, cells, total) for i, c in enumerate(columns)]
    spark.createDataFrame(index, _INDEX).coalesce(1).write.parquet(f"{path}/index")
    return CountCube(spark, path)


def with_cube(cohort: Cohort, cube: CountCube) -> Cohort:
    """``cohort`` with count tables read from the cube; one of other data is refused."""
    if cube.rows != cohort.book.rows:
        raise ValueError("the cube counts another number of rows than the dataset has")
    return cohort.counted_by(cube)
